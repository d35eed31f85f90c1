"""Which tokens survive: cuts by frequency, rules, closure over merges, a cap."""

from __future__ import annotations

import heapq
import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tokenloom.operators.presets import resolve_preset
from tokenloom.operators.ranking import ranked
from tokenloom.sources.backends import get_backend
from tokenloom.sources.corpus import read_token_file
from tokenloom.sources.scratch import cut, cut_counted, lookup_side

log = logging.getLogger(__name__)
#: Dependencies that a round of the closure follows.
HOPS = 4
STRUCTURAL, CORPUS, DEPENDENCY = "structural", "corpus", "dependency"


def rank_counts(counts: DataFrame, key: str = "token_id") -> DataFrame:
    """Add rk (by falling n, then key), before (occurrences of all tokens ranked higher) and total (of all)."""
    return ranked(counts, [F.desc("n"), F.asc(key)], total_of="n")


def cut_by_corpus(counts: DataFrame, min_count: int | None = None, top_k: int | None = None, coverage: float | None = None, total: int | Column | None = None, key: str = "token_id") -> DataFrame:
    """The strictest of the cuts: all are prefixes of one ranking. ``total`` is the stored total of occurrences, by default
    their sum, which the ranking gives; a coverage it can't reach keeps everything."""
    rows = rank_counts(counts, key)
    if min_count is not None:
        rows = rows.where(F.col("n") >= min_count)
    if top_k is not None:
        rows = rows.where(F.col("rk") <= top_k)
    if coverage is not None:
        whole = F.col("total") if total is None else total if isinstance(total, Column) else F.lit(total)
        target = F.lit(coverage) * whole
        rows = rows.where((F.col("before") < target) | (F.col("rk") == 1))
    return rows


def merge_dependencies(merges: DataFrame, vocab: DataFrame) -> DataFrame:
    """child, parent, slot: each merged token's parts by its first rule whose three tokens all exist."""
    ids = lambda name: vocab.select(F.col("token").alias(name), F.col("token_id").alias(f"{name}_id"))
    valid = merges.withColumn("merged", F.concat("left", "right")).join(ids("left"), "left").join(ids("right"), "right").join(ids("merged"), "merged")
    first = valid.groupBy("merged_id").agg(F.min_by(F.struct("left_id", "right_id"), "rank").alias("pair"))
    parts = F.posexplode(F.array("pair.left_id", "pair.right_id")).alias("slot", "parent")
    return first.select(F.col("merged_id").alias("child"), parts).select("child", "parent", "slot")


def expand_dependencies(kept: DataFrame, deps: DataFrame, key: str = "token_id") -> DataFrame:
    """The tokens that kept ones need and that aren't kept. A round follows HOPS dependencies from its frontier and writes what
    is new to a table of its own; the next begins at what the last hop found."""
    edges = lookup_side(*cut_counted(deps.select(F.col("child").alias(key), "parent").distinct(), "edges"))
    start = cut(kept.select(key).distinct(), "start")
    added = start.limit(0)
    frontier = start
    while True:
        found, step = None, frontier
        for hop in range(HOPS):
            step = edges.join(step, key).select(F.col("parent").alias(key)).distinct()
            marked = step.withColumn("hop", F.lit(hop))
            found = marked if found is None else found.unionByName(marked)
        nearest = found.groupBy(key).agg(F.min("hop").alias("hop"))
        new, n = cut_counted(nearest.join(start.unionByName(added), key, "left_anti"), "frontier")
        if not n:
            return added
        added = added.unionByName(new.select(key))
        frontier = new.where(F.col("hop") == HOPS - 1).select(key)


def provenance(sources: list[DataFrame]) -> DataFrame:
    """token_id and reasons (sorted) of the union of (token_id, reason) tables."""
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("token_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def counts_by_reason(selection: DataFrame) -> DataFrame:
    return selection.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason")


def cap_flat(selection: DataFrame, counts: DataFrame, cap: int) -> DataFrame:
    """Selection with dropped (boolean) where no token depends on another: the least frequent, then highest ids, go."""
    rows = selection.join(counts.select("token_id", "n"), "token_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fixed = rows.where("structural")
    loose = ranked(rows.where("NOT structural"), [F.desc("n"), F.asc("token_id")])
    room = F.lit(cap) - F.lit(fixed.count())
    return fixed.withColumn("dropped", F.lit(False)).unionByName(loose.withColumn("dropped", F.col("rk") > room).drop("rk"))


def cap_order(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """token_id, freq and block of every token that can be removed.

    Removal goes by rising (freq, -id) of tokens that nothing kept depends on. A token can't go before any that
    depends on it, so its block is the greatest key among itself and all its dependents; tokens go block by block. Tokens
    under a structural one or on a cycle never go. ``nodes``: token_id, freq, structural.
    """
    edges = deps.select("child", "parent").where("child <> parent").distinct()
    edges = edges.join(nodes.select(F.col("token_id").alias("child")), "child").join(nodes.select(F.col("token_id").alias("parent")), "parent")
    edges = cut(edges, "edges")
    key = F.struct(F.col("freq").alias("f"), (-F.col("token_id")).alias("i"))
    state = nodes.where("NOT structural").select("token_id", "freq", key.alias("key"))
    # Nothing depends on a leaf: its block is its own key.
    leaves = state.join(edges.select(F.col("parent").alias("token_id")).distinct(), "token_id", "left_anti").select("token_id", F.col("key").alias("block"))
    done = F.count("block")
    state, settled = cut_counted(state.join(leaves, "token_id", "left"), "blocks", done)
    while True:
        # Others settle once all that depend on them have; a structural dependent never does.
        below = state.select(F.col("token_id").alias("child"), "block")
        above = edges.join(below, "child", "left").groupBy(F.col("parent").alias("token_id")).agg(F.max("block").alias("above"), F.max(F.col("block").isNull()).alias("open"))
        ready = F.when(~F.col("open"), F.greatest("key", "above"))
        state, now = cut_counted(state.join(above, "token_id", "left").select("token_id", "freq", "key", F.coalesce("block", ready).alias("block")), "blocks", done)
        if now == settled:
            return state.where("block IS NOT NULL").select("token_id", "freq", "block")
        settled = now


def _greedy(tokens: list[tuple[int, int]], edges: list[tuple[int, int]], need: int) -> list[int]:
    """The first ``need`` removals within one block: (id, freq) and (child, parent)."""
    freq = dict(tokens)
    dependents: dict[int, int] = dict.fromkeys(freq, 0)
    parents: dict[int, list[int]] = {}
    for child, parent in edges:
        dependents[parent] += 1
        parents.setdefault(child, []).append(parent)
    heap = [(freq[t], -t) for t in freq if not dependents[t]]
    heapq.heapify(heap)
    out = []
    while heap and len(out) < need:
        token = -heapq.heappop(heap)[1]
        out.append(token)
        for parent in parents.get(token, []):
            dependents[parent] -= 1
            if not dependents[parent]:
                heapq.heappush(heap, (freq[parent], -parent))
    return out


def removal_blocks(nodes: DataFrame, deps: DataFrame) -> DataFrame:
    """block, tokens and before (tokens of earlier blocks), in the order in which blocks go."""
    return ranked(cap_order(nodes, deps).groupBy("block").agg(F.count("*").alias("tokens")), [F.asc("block")], total_of="tokens")


def apply_cap(nodes: DataFrame, deps: DataFrame | None, cap: int) -> DataFrame:
    """token_id of the removed tokens. Whole blocks go below the cut; only the one it falls in, which holds the ancestors of one
    token at most, is ordered on the driver."""
    size = nodes.count()
    fixed = nodes.where("structural").count()
    none = nodes.select("token_id").limit(0)
    if size <= cap:
        return none
    if fixed > cap:
        raise ValueError(f"max_vocab_size={cap:,} is below the {fixed:,} structural tokens that cannot be removed")
    need = size - cap
    if deps is None:
        loose = ranked(nodes.where("NOT structural"), [F.asc("freq"), F.desc("token_id")])
        return loose.where(F.col("rk") <= need).select("token_id")
    blocks = cap_order(nodes, deps)
    sizes = ranked(blocks.groupBy("block").agg(F.count("*").alias("tokens")), [F.asc("block")], total_of="tokens")
    whole = sizes.where(F.col("before") + F.col("tokens") <= need).select("block")
    gone = blocks.join(whole, "block").select("token_id")
    edge = sizes.where((F.col("before") < need) & (F.col("before") + F.col("tokens") > need)).first()
    if edge is None:
        if blocks.count() < need:
            log.warning("could not shrink below %d tokens without making others unreachable", size - blocks.count())
        return gone
    inside = blocks.where(F.col("block") == F.struct(F.lit(edge["block"]["f"]).alias("f"), F.lit(edge["block"]["i"]).alias("i")))
    tokens = [(r["token_id"], r["freq"]) for r in inside.select("token_id", "freq").collect()]
    names = nodes.sparkSession.createDataFrame([(t,) for t, _ in tokens], "token_id int")
    within = deps.select("child", "parent").distinct().where("child <> parent").join(names.select(F.col("token_id").alias("child")), "child").join(names.select(F.col("token_id").alias("parent")), "parent")
    last = _greedy(tokens, [(r["child"], r["parent"]) for r in within.collect()], need - edge["before"])
    return gone.unionByName(nodes.sparkSession.createDataFrame([(t,) for t in last], "token_id int").select(F.col("token_id").cast(dict(gone.dtypes)["token_id"])))


@dataclass
class Selection:
    """kept: token_id, reasons, structural; dropped: requested tokens that the cap removed, with their reasons."""

    kept: DataFrame
    dropped: DataFrame
    unknown: list[str] = field(default_factory=list)
    missed_cap: bool = False

    def ids(self) -> list[int]:
        return [r["token_id"] for r in self.kept.select("token_id").orderBy("token_id").collect()]

    def by_reason(self) -> dict[str, int]:
        return {r["reason"]: r["n"] for r in counts_by_reason(self.kept).collect()}


def look_up(asked: DataFrame, vocab: DataFrame) -> DataFrame:
    """Requested tokens with their ids, null for those that the vocabulary hasn't."""
    return asked.join(vocab.select("token", "token_id"), "token", "left")


def matching(vocab: DataFrame, pattern: str) -> DataFrame:
    """token_id and reason of the tokens whose surface (or, for want of one, whose own string) matches."""
    seen = F.coalesce(F.when(F.col("surface") != "", F.col("surface")), F.col("token"))
    return vocab.where(seen.rlike(f"(?U){pattern}")).select("token_id", F.lit(f"pattern:{pattern}").alias("reason"))


def requested(document, tables: dict[str, DataFrame], config) -> tuple[DataFrame | None, list[str]]:
    """(token_id, reason) of everything asked for by name, and the tokens that aren't in the vocabulary, in order."""
    spark, vocab = tables["vocab"].sparkSession, tables["vocab"]
    named = lambda tokens, reason: tokens.join(vocab.select("token", "token_id"), "token").select("token_id", F.lit(reason).alias("reason"))
    found = [named(resolve_preset(name, document, tables), f"preset:{name}") for name in config.keep_presets]
    unknown: list[str] = []
    literals = [(t, "explicit_token") for t in config.keep_tokens] + [(t, f"file:{p}") for p in config.keep_token_files for t in read_token_file(p)]
    if literals:
        asked = look_up(spark.createDataFrame([(i, t, r) for i, (t, r) in enumerate(literals)], "ord int, token string, reason string"), vocab)
        found.append(asked.where("token_id IS NOT NULL").select("token_id", "reason"))
        unknown = [r["token"] for r in asked.where("token_id IS NULL").orderBy("ord").collect()]
    if config.keep_token_ids:
        ids = spark.createDataFrame([(i,) for i in config.keep_token_ids], "token_id int")
        missing = ids.join(vocab.select("token_id"), "token_id", "left_anti").first()
        if missing:
            raise ValueError(f"requested token id {missing[0]} does not exist in {document.source or 'this tokenizer'}")
        found.append(ids.select("token_id", F.lit("explicit_id").alias("reason")))
    from tokenloom.operators.encode import encode

    spoken = [(t, "text") for t in config.keep_texts] + ([(document.literals, "chat_template")] if config.keep_chat_template and document.literals.strip() else [])
    if spoken:
        coded = encode(spark.createDataFrame(spoken, "text string, reason string"), document.to_json(), ["reason"])
        found.append(coded.select(F.explode("ids").alias("token_id"), "reason").distinct())
    found += [matching(vocab, p) for p in config.keep_patterns]
    if not found:
        return None, unknown
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, unknown


def select_tokens(document, tables: dict[str, DataFrame], counts, config) -> Selection:
    """The union of structural, requested and corpus tokens, closed over merges, then capped."""
    structural = tables["structural"].select("token_id", F.lit(STRUCTURAL).alias("reason"))
    sources = [structural]
    asked, unknown = requested(document, tables, config)
    if asked is not None:
        sources.append(asked)
    if counts is not None:
        chosen = cut_by_corpus(counts.counts, config.min_count, config.top_k, config.coverage, counts.total)
        sources.append(chosen.select("token_id", F.lit(CORPUS).alias("reason")))
    kept = cut(provenance(sources), "kept")
    deps = get_backend(document.model_type).dependencies(tables)
    if deps is not None:
        deps = cut(deps, "deps")
        more = expand_dependencies(kept, deps).select("token_id", F.array(F.lit(DEPENDENCY)).alias("reasons"))
        kept = cut(kept.unionByName(more), "closed")
    kept = kept.withColumn("structural", F.array_contains("reasons", STRUCTURAL))
    dropped = kept.select("token_id", "reasons").limit(0)
    missed = False
    if config.max_vocab_size is not None:
        freq = counts.counts.select("token_id", F.col("n").alias("freq")) if counts is not None else kept.select("token_id", F.lit(0).cast("long").alias("freq"))
        nodes = cut(kept.join(freq, "token_id", "left").select("token_id", F.coalesce("freq", F.lit(0)).alias("freq"), "structural"), "nodes")
        gone = cut(apply_cap(nodes, deps, config.max_vocab_size), "gone")
        why = F.array_except("reasons", F.array(F.lit(CORPUS), F.lit(DEPENDENCY)))
        dropped = cut(kept.join(gone, "token_id").select("token_id", why.alias("reasons")).where(F.size("reasons") > 0), "dropped")
        kept = cut(kept.join(gone, "token_id", "left_anti"), "capped")
        missed = kept.count() > config.max_vocab_size
    if unknown:
        log.warning("%d requested tokens are not in this vocabulary, e.g. %s", len(unknown), ", ".join(map(repr, unknown[:5])))
    return Selection(kept, dropped, unknown, missed)
