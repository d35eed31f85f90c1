"""Messages of this package on standard error."""

from __future__ import annotations

import logging
import sys

_handler: logging.Handler | None = None


def show_messages(level: int | str = logging.INFO) -> logging.Logger:
    """Send this package's messages to standard error. Called again it changes the level; there is one handler at any time."""
    global _handler
    own = logging.getLogger("tokenloom")
    if _handler is not None:
        own.removeHandler(_handler)
    _handler = logging.StreamHandler(sys.stderr)
    _handler.setFormatter(logging.Formatter("%(levelname)s %(name)s: %(message)s"))
    own.addHandler(_handler)
    own.setLevel(level)
    return own
