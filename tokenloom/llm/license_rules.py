"""Signature rules for licence texts, notices and identifiers.

One rule a line: label ~ priority ~ confidence in hundredths ~ keyword ~ expression. The text is lower-cased (A-Z); a
blank in an expression stands for any white space, hyphen or comment sign between words. The keyword, or one of several with | between, is
in every match of its expression; a text without it isn't searched. Higher priorities win: 90 identifiers, 80 full
titles with version, 70 addresses, 60 sentences of the licence text, 50 names, 40 general notices.
"""

TEXT = r"""
mit ~ 90 ~ 100 ~ spdx ~ spdx license identifier: mit\b
mit-0 ~ 91 ~ 100 ~ spdx ~ spdx license identifier: mit-0\b
apache-2.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: apache-2\.0
apache-1.1 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: apache-1\.1
gpl-1.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: gpl-1\.0
gpl-2.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: gpl-2\.0
gpl-3.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: gpl-3\.0
lgpl-2.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: lgpl-2\.0
lgpl-2.1 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: lgpl-2\.1
lgpl-3.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: lgpl-3\.0
agpl-3.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: agpl-3\.0
bsd-2-clause ~ 90 ~ 100 ~ spdx ~ spdx license identifier: bsd-2-clause
bsd-3-clause ~ 90 ~ 100 ~ spdx ~ spdx license identifier: bsd-3-clause
bsd-4-clause ~ 90 ~ 100 ~ spdx ~ spdx license identifier: bsd-4-clause
0bsd ~ 90 ~ 100 ~ spdx ~ spdx license identifier: 0bsd
isc ~ 90 ~ 100 ~ spdx ~ spdx license identifier: isc\b
mpl-1.1 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: mpl-1\.1
mpl-2.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: mpl-2\.0
epl-1.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: epl-1\.0
epl-2.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: epl-2\.0
eupl-1.2 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: eupl-1\.2
cddl-1.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: cddl-1\.0
cddl-1.1 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: cddl-1\.1
bsl-1.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: bsl-1\.0
zlib ~ 90 ~ 100 ~ spdx ~ spdx license identifier: zlib\b
unlicense ~ 90 ~ 100 ~ spdx ~ spdx license identifier: unlicense
wtfpl ~ 90 ~ 100 ~ spdx ~ spdx license identifier: wtfpl
cc0-1.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: cc0-1\.0
cc-by-3.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: cc-by-3\.0
cc-by-4.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: cc-by-4\.0
cc-by-sa-3.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: cc-by-sa-3\.0
cc-by-sa-4.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: cc-by-sa-4\.0
cc-by-nc-4.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: cc-by-nc-4\.0
cc-by-nd-4.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: cc-by-nd-4\.0
artistic-1.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: artistic-1\.0
artistic-2.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: artistic-2\.0
ofl-1.1 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: ofl-1\.1
postgresql ~ 90 ~ 100 ~ spdx ~ spdx license identifier: postgresql
psf-2.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: (?:psf-2\.0|python-2\.0)
ncsa ~ 90 ~ 100 ~ spdx ~ spdx license identifier: ncsa
openssl ~ 90 ~ 100 ~ spdx ~ spdx license identifier: openssl
php-3.01 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: php-3\.01
ms-pl ~ 90 ~ 100 ~ spdx ~ spdx license identifier: ms-pl
ms-rl ~ 90 ~ 100 ~ spdx ~ spdx license identifier: ms-rl
sspl-1.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: sspl-1\.0
busl-1.1 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: busl-1\.1
elastic-2.0 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: elastic-2\.0
gfdl-1.3 ~ 90 ~ 100 ~ spdx ~ spdx license identifier: gfdl-1\.3
other-spdx ~ 85 ~ 80 ~ spdx ~ spdx license identifier: [\w.+-]+
apache-2.0 ~ 80 ~ 95 ~ apache ~ apache license,? (?:version )?v?2(?:\.0)?\b
apache-2.0 ~ 80 ~ 95 ~ apache ~ apache software license,? (?:version )?v?2(?:\.0)?\b
apache-1.1 ~ 80 ~ 95 ~ apache ~ apache (?:software )?license,? (?:version )?v?1\.1
apache-1.0 ~ 80 ~ 95 ~ apache ~ apache (?:software )?license,? (?:version )?v?1\.0
apache-2.0 ~ 70 ~ 95 ~ apache ~ www\.apache\.org/licenses/license-2\.0
apache-2.0 ~ 60 ~ 90 ~ apache ~ licensed under the apache license
apache ~ 50 ~ 75 ~ apache ~ apache licen[sc]e
apache ~ 50 ~ 70 ~ apache ~ apache software foundation
apache ~ 45 ~ 60 ~ apache ~ (?:under|licensed) (?:the )?apache\b
apache-2.0 ~ 50 ~ 80 ~ asl ~ \basl ?2(?:\.0)?\b
mit ~ 80 ~ 90 ~ licen ~ \bthe mit licen[sc]e\b
mit ~ 50 ~ 75 ~ licen ~ \bmit licen[sc]e\b
mit ~ 60 ~ 90 ~ licen ~ licensed under (?:the )?mit\b
mit ~ 60 ~ 90 ~ permission ~ permission is hereby granted, free of charge, to any person obtaining a copy of this software
mit ~ 60 ~ 85 ~ software ~ the software is provided "?as is"?, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability
mit ~ 60 ~ 85 ~ copyright ~ the above copyright notice and this permission notice shall be included in all copies
mit ~ 70 ~ 95 ~ opensource ~ opensource\.org/licenses/mit\b
mit ~ 50 ~ 70 ~ expat ~ \bexpat licen[sc]e\b
x11 ~ 50 ~ 75 ~ x11 ~ \bx11 licen[sc]e\b
x11 ~ 60 ~ 85 ~ consortium ~ except as contained in this notice, the name of the x consortium shall not be used
mit-0 ~ 81 ~ 95 ~ attribution ~ \bmit no attribution\b
gpl-3.0 ~ 80 ~ 95 ~ general ~ gnu general public licen[sc]e,? (?:version )?v?3(?:\.0)?\b
gpl-2.0 ~ 80 ~ 95 ~ general ~ gnu general public licen[sc]e,? (?:version )?v?2(?:\.0)?\b
gpl-1.0 ~ 80 ~ 95 ~ general ~ gnu general public licen[sc]e,? (?:version )?v?1(?:\.0)?\b
gpl ~ 50 ~ 75 ~ general ~ \bgeneral public licen[sc]e\b
gpl ~ 55 ~ 80 ~ general ~ gnu general public licen[sc]e\b
gpl ~ 60 ~ 85 ~ general ~ redistribute it and/or modify it under the terms of the gnu general public licen[sc]e
gpl-3.0 ~ 70 ~ 95 ~ gpl ~ gnu\.org/licenses/gpl-3\.0
gpl-2.0 ~ 70 ~ 95 ~ gpl ~ gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl ~ 70 ~ 85 ~ gpl ~ gnu\.org/licenses/gpl\b
gpl-3.0 ~ 50 ~ 85 ~ gpl ~ \bgpl ?v?3(?:\.0)?\b
gpl-2.0 ~ 50 ~ 85 ~ gpl ~ \bgpl ?v?2(?:\.0)?\b
gpl ~ 45 ~ 60 ~ gpl ~ \bgnu gpl\b
gpl ~ 45 ~ 60 ~ gpl ~ \bgpl licen[sc]ed?\b
gpl ~ 60 ~ 80 ~ warranty ~ this program is distributed in the hope that it will be useful, but without any warranty
gpl ~ 60 ~ 80 ~ everyone ~ everyone is permitted to copy and distribute verbatim copies of this license document
gpl-classpath ~ 82 ~ 95 ~ classpath ~ classpath exception
gpl-linking ~ 62 ~ 80 ~ linking ~ as a special exception,? .{0,80}linking
lgpl-3.0 ~ 80 ~ 95 ~ lesser ~ gnu lesser general public licen[sc]e,? (?:version )?v?3(?:\.0)?\b
lgpl-2.1 ~ 80 ~ 95 ~ lesser ~ gnu lesser general public licen[sc]e,? (?:version )?v?2\.1\b
lgpl ~ 56 ~ 80 ~ lesser ~ \blesser general public licen[sc]e\b
lgpl-2.0 ~ 80 ~ 95 ~ library ~ gnu library general public licen[sc]e,? (?:version )?v?2(?:\.0)?\b
lgpl ~ 56 ~ 80 ~ library ~ \blibrary general public licen[sc]e\b
lgpl-3.0 ~ 50 ~ 85 ~ lgpl ~ \blgpl ?v?3(?:\.0)?\b
lgpl-2.1 ~ 50 ~ 85 ~ lgpl ~ \blgpl ?v?2\.1\b
lgpl ~ 45 ~ 60 ~ lgpl ~ \bgnu lgpl\b
lgpl ~ 70 ~ 90 ~ lgpl ~ gnu\.org/licenses/lgpl
agpl-3.0 ~ 80 ~ 95 ~ affero ~ gnu affero general public licen[sc]e,? (?:version )?v?3(?:\.0)?\b
agpl ~ 57 ~ 80 ~ affero ~ \baffero general public licen[sc]e\b
agpl-3.0 ~ 70 ~ 95 ~ agpl ~ gnu\.org/licenses/agpl
agpl-3.0 ~ 50 ~ 85 ~ agpl ~ \bagpl ?v?3(?:\.0)?\b
gfdl ~ 56 ~ 85 ~ documentation ~ gnu free documentation licen[sc]e
gfdl-1.3 ~ 80 ~ 95 ~ documentation ~ gnu free documentation licen[sc]e,? (?:version )?1\.3
gfdl-1.2 ~ 80 ~ 95 ~ documentation ~ gnu free documentation licen[sc]e,? (?:version )?1\.2
gfdl ~ 60 ~ 85 ~ invariant ~ with no invariant sections, (?:with )?no front cover texts
bsd-3-clause ~ 80 ~ 95 ~ bsd ~ \b(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)\b
bsd-2-clause ~ 80 ~ 95 ~ bsd ~ \b(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd licen[sc]e)\b
bsd-4-clause ~ 80 ~ 95 ~ bsd ~ \b(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)\b
0bsd ~ 80 ~ 95 ~ bsd ~ \b(?:zero clause bsd|bsd zero clause|0bsd)\b
bsd ~ 50 ~ 75 ~ bsd ~ \bbsd licen[sc]e\b
bsd ~ 50 ~ 70 ~ bsd ~ \bbsd style licen[sc]e\b
bsd ~ 60 ~ 85 ~ redistribution ~ redistributions? (?:and use )?in source and binary forms, with or without modification, are permitted
bsd ~ 58 ~ 80 ~ redistributions ~ redistributions of source code must retain the above copyright notice
bsd ~ 58 ~ 80 ~ redistributions ~ redistributions in binary form must reproduce the above copyright notice
bsd-3-clause ~ 61 ~ 85 ~ endorse ~ neither the name of .{1,120}? may be used to endorse or promote products
bsd-4-clause ~ 61 ~ 85 ~ advertising ~ all advertising materials mentioning features or use of this software
bsd-3-clause ~ 70 ~ 95 ~ opensource ~ opensource\.org/licenses/bsd-3-clause
bsd-2-clause ~ 70 ~ 95 ~ opensource ~ opensource\.org/licenses/bsd-2-clause
isc ~ 50 ~ 80 ~ isc ~ \bisc licen[sc]e\b
isc ~ 60 ~ 90 ~ permission ~ permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
isc ~ 70 ~ 95 ~ opensource ~ opensource\.org/licenses/isc
mpl-2.0 ~ 80 ~ 95 ~ mozilla ~ mozilla public licen[sc]e,? (?:version |v\.? ?)?2\.0
mpl-1.1 ~ 80 ~ 95 ~ mozilla ~ mozilla public licen[sc]e,? (?:version |v\.? ?)?1\.1
mpl-1.0 ~ 80 ~ 95 ~ mozilla ~ mozilla public licen[sc]e,? (?:version |v\.? ?)?1\.0
mpl ~ 50 ~ 75 ~ mozilla ~ mozilla public licen[sc]e
mpl-2.0 ~ 70 ~ 95 ~ mozilla ~ mozilla\.org/mpl/2\.0
mpl-2.0 ~ 60 ~ 90 ~ source ~ this source code form is subject to the terms of the mozilla
mpl-2.0 ~ 50 ~ 80 ~ mpl ~ \bmpl ?v?2(?:\.0)?\b
epl-2.0 ~ 80 ~ 95 ~ eclipse ~ eclipse public licen[sc]e,? (?:version |v\.? ?)?2\.0
epl-1.0 ~ 80 ~ 95 ~ eclipse ~ eclipse public licen[sc]e,? (?:version |v\.? ?)?1\.0
epl ~ 50 ~ 75 ~ eclipse ~ eclipse public licen[sc]e
edl-1.0 ~ 50 ~ 80 ~ eclipse ~ eclipse distribution licen[sc]e
epl ~ 70 ~ 90 ~ eclipse ~ eclipse\.org/legal/epl
eupl-1.2 ~ 80 ~ 95 ~ union ~ european union public licen[sc]e,? (?:version |v\.? ?)?1\.2
eupl ~ 50 ~ 75 ~ union ~ european union public licen[sc]e
cddl-1.0 ~ 80 ~ 95 ~ distribution ~ common development and distribution licen[sc]e,? (?:\(cddl\) )?(?:version |v\.? ?)?1\.0
cddl-1.1 ~ 80 ~ 95 ~ distribution ~ common development and distribution licen[sc]e,? (?:\(cddl\) )?(?:version |v\.? ?)?1\.1
cddl ~ 50 ~ 75 ~ distribution ~ common development and distribution licen[sc]e
cpl-1.0 ~ 50 ~ 75 ~ common ~ \bcommon public licen[sc]e\b
ipl-1.0 ~ 50 ~ 75 ~ ibm ~ \bibm public licen[sc]e\b
bsl-1.0 ~ 80 ~ 95 ~ boost ~ boost software licen[sc]e,? (?:version )?1\.0
bsl-1.0 ~ 50 ~ 80 ~ boost ~ boost software licen[sc]e
bsl-1.0 ~ 70 ~ 95 ~ boost ~ boost\.org/license_1_0
zlib ~ 50 ~ 75 ~ zlib ~ \bzlib(?:/libpng)? licen[sc]e\b
zlib ~ 60 ~ 90 ~ implied ~ provided 'as is', without any express or implied warranty\. in no event will the authors be held liable
zlib ~ 60 ~ 85 ~ misrepresented ~ the origin of this software must not be misrepresented
libpng ~ 50 ~ 75 ~ libpng ~ \blibpng licen[sc]e\b
unlicense ~ 60 ~ 95 ~ unencumbered ~ this is free and unencumbered software released into the public domain
unlicense ~ 50 ~ 80 ~ unlicense ~ \bthe unlicense\b
unlicense ~ 70 ~ 95 ~ unlicense ~ unlicense\.org
wtfpl ~ 50 ~ 90 ~ public ~ do what the fuck you want to public licen[sc]e
wtfpl ~ 50 ~ 80 ~ wtfpl ~ \bwtfpl\b
cc0-1.0 ~ 80 ~ 95 ~ cc0 ~ \bcc0 1\.0(?: universal)?\b
cc0-1.0 ~ 50 ~ 80 ~ cc0 ~ \bcc0\b
cc0-1.0 ~ 70 ~ 95 ~ creativecommons ~ creativecommons\.org/publicdomain/zero
cc-by-4.0 ~ 80 ~ 95 ~ creative ~ creative commons attribution (?:licen[sc]e )?4\.0
cc-by-3.0 ~ 80 ~ 95 ~ creative ~ creative commons attribution (?:licen[sc]e )?3\.0
cc-by-2.0 ~ 80 ~ 95 ~ creative ~ creative commons attribution (?:licen[sc]e )?2\.0
cc-by-sa-4.0 ~ 81 ~ 95 ~ creative ~ creative commons attribution share ?alike (?:licen[sc]e )?4\.0
cc-by-sa-3.0 ~ 81 ~ 95 ~ creative ~ creative commons attribution share ?alike (?:licen[sc]e )?3\.0
cc-by-sa ~ 56 ~ 80 ~ creative ~ creative commons attribution share ?alike
cc-by-nc-4.0 ~ 81 ~ 95 ~ creative ~ creative commons attribution non ?commercial (?:licen[sc]e )?4\.0
cc-by-nc ~ 56 ~ 80 ~ creative ~ creative commons attribution non ?commercial
cc-by-nc-sa ~ 57 ~ 85 ~ creative ~ creative commons attribution non ?commercial share ?alike
cc-by-nc-nd ~ 57 ~ 85 ~ creative ~ creative commons attribution non ?commercial no ?deriv
cc-by-nd ~ 56 ~ 80 ~ creative ~ creative commons attribution no ?deriv
cc-by ~ 50 ~ 75 ~ creative ~ creative commons attribution
cc ~ 45 ~ 60 ~ creative ~ creative commons licen[sc]e
cc-by-4.0 ~ 70 ~ 95 ~ creativecommons ~ creativecommons\.org/licenses/by/4\.0
cc-by-3.0 ~ 70 ~ 95 ~ creativecommons ~ creativecommons\.org/licenses/by/3\.0
cc-by-sa-4.0 ~ 70 ~ 95 ~ creativecommons ~ creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0 ~ 70 ~ 95 ~ creativecommons ~ creativecommons\.org/licenses/by-sa/3\.0
cc-by-nc ~ 70 ~ 90 ~ creativecommons ~ creativecommons\.org/licenses/by-nc/
cc-by-nd ~ 70 ~ 90 ~ creativecommons ~ creativecommons\.org/licenses/by-nd/
cc-by-nc-sa ~ 70 ~ 90 ~ creativecommons ~ creativecommons\.org/licenses/by-nc-sa/
cc-by-nc-nd ~ 70 ~ 90 ~ creativecommons ~ creativecommons\.org/licenses/by-nc-nd/
cc-by-4.0 ~ 50 ~ 85 ~ cc ~ \bcc by 4\.0\b
cc-by-sa-4.0 ~ 50 ~ 85 ~ cc ~ \bcc by sa 4\.0\b
cc-by-nc ~ 50 ~ 80 ~ cc ~ \bcc by nc\b
cc-by-sa ~ 50 ~ 80 ~ cc ~ \bcc by sa\b
artistic-2.0 ~ 80 ~ 95 ~ artistic ~ artistic licen[sc]e,? (?:version )?2\.0
artistic-1.0 ~ 80 ~ 95 ~ artistic ~ artistic licen[sc]e,? (?:version )?1\.0
artistic ~ 50 ~ 75 ~ artistic ~ \bartistic licen[sc]e\b
perl ~ 60 ~ 80 ~ perl ~ under the same terms as perl itself
psf ~ 50 ~ 80 ~ python ~ python software foundation licen[sc]e
psf ~ 50 ~ 70 ~ psf ~ \bpsf licen[sc]e\b
ruby ~ 50 ~ 70 ~ ruby ~ \bruby licen[sc]e\b
php-3.01 ~ 80 ~ 95 ~ php ~ php licen[sc]e,? (?:version )?3\.01
php ~ 50 ~ 70 ~ php ~ \bphp licen[sc]e\b
zend-2.0 ~ 50 ~ 75 ~ zend ~ \bzend (?:engine )?licen[sc]e\b
ofl-1.1 ~ 80 ~ 95 ~ font ~ sil open font licen[sc]e,? (?:version )?1\.1
ofl ~ 50 ~ 80 ~ font ~ \b(?:sil )?open font licen[sc]e\b
ofl ~ 70 ~ 95 ~ scripts ~ scripts\.sil\.org/ofl
ofl ~ 60 ~ 85 ~ reserved ~ with reserved font names?
ubuntu-font ~ 50 ~ 80 ~ font ~ \bubuntu font licen[sc]e\b
postgresql ~ 50 ~ 80 ~ postgresql ~ \bpostgresql licen[sc]e\b
ncsa ~ 50 ~ 80 ~ ncsa ~ \b(?:university of illinois/)?ncsa open source licen[sc]e\b
openssl ~ 50 ~ 80 ~ openssl ~ \bopenssl licen[sc]e\b
openssl ~ 60 ~ 85 ~ openssl ~ includes software developed by the openssl project
ssleay ~ 60 ~ 80 ~ eric ~ cryptographic software written by eric young
curl ~ 50 ~ 75 ~ curl ~ \bcurl licen[sc]e\b
vim ~ 50 ~ 75 ~ vim ~ \bvim licen[sc]e\b
tcl ~ 50 ~ 75 ~ tcl ~ \btcl/tk licen[sc]e\b
w3c ~ 50 ~ 80 ~ w3c ~ \bw3c software (?:notice and )?licen[sc]e\b
ijg ~ 60 ~ 80 ~ jpeg ~ based in part on the work of the independent jpeg group
freetype ~ 50 ~ 80 ~ freetype ~ \bfreetype (?:project )?licen[sc]e\b
imagemagick ~ 50 ~ 75 ~ imagemagick ~ \bimagemagick licen[sc]e\b
icu ~ 50 ~ 75 ~ icu ~ \bicu licen[sc]e\b
unicode ~ 50 ~ 80 ~ unicode ~ \bunicode(?:, inc\.?)? licen[sc]e agreement\b
ms-pl ~ 50 ~ 80 ~ microsoft ~ \bmicrosoft public licen[sc]e\b
ms-rl ~ 50 ~ 80 ~ microsoft ~ \bmicrosoft reciprocal licen[sc]e\b
ms-eula ~ 50 ~ 70 ~ microsoft ~ microsoft software licen[sc]e terms
sspl-1.0 ~ 50 ~ 85 ~ server ~ \bserver side public licen[sc]e\b
busl-1.1 ~ 50 ~ 85 ~ business ~ \bbusiness source licen[sc]e\b
elastic ~ 50 ~ 80 ~ elastic ~ \belastic licen[sc]e\b
commons-clause ~ 50 ~ 80 ~ commons ~ \bcommons clause\b
polyform ~ 50 ~ 80 ~ polyform ~ \bpolyform (?:noncommercial|shield|small business|perimeter)\b
json ~ 60 ~ 85 ~ evil ~ the software shall be used for good, not evil
beerware ~ 50 ~ 80 ~ beer ~ \bbeer ?ware licen[sc]e\b
beerware ~ 60 ~ 85 ~ beer ~ you can buy me a beer in return
apsl-2.0 ~ 50 ~ 80 ~ apple ~ \bapple public source licen[sc]e\b
afl-3.0 ~ 50 ~ 80 ~ academic ~ \bacademic free licen[sc]e\b
osl-3.0 ~ 50 ~ 75 ~ open ~ \bopen software licen[sc]e\b
ecl-2.0 ~ 50 ~ 80 ~ educational ~ \beducational community licen[sc]e\b
cecill-2.1 ~ 50 ~ 80 ~ cecill ~ \bcecill(?: free software licen[sc]e)?\b
odbl-1.0 ~ 50 ~ 80 ~ database ~ \bopen database licen[sc]e\b
odc-by-1.0 ~ 50 ~ 80 ~ commons ~ \bopen data commons attribution\b
pddl-1.0 ~ 50 ~ 80 ~ commons ~ \bopen data commons public domain\b
upl-1.0 ~ 50 ~ 75 ~ universal ~ \buniversal permissive licen[sc]e\b
lppl ~ 50 ~ 80 ~ latex ~ \blatex project public licen[sc]e\b
mulan-psl-2.0 ~ 50 ~ 80 ~ mulan ~ \bmulan permissive software licen[sc]e\b
openrail ~ 50 ~ 80 ~ rail ~ \b(?:open|bigscience |creativeml )rail(?: m| \+\+ m)?\b
llama ~ 50 ~ 80 ~ llama ~ \bllama ?[23]?(?:\.\d)? community licen[sc]e\b
gemma ~ 50 ~ 75 ~ gemma ~ \bgemma terms of use\b
ogl-3.0 ~ 50 ~ 75 ~ government ~ \bopen government licen[sc]e\b
public-domain ~ 45 ~ 60 ~ public ~ \b(?:in|into|to) the public domain\b
public-domain ~ 45 ~ 70 ~ public ~ \bpublic domain dedication\b
public-domain ~ 47 ~ 75 ~ dedicate ~ dedicates? (?:this|the) (?:work|software) to the public domain
proprietary ~ 45 ~ 60 ~ proprietary ~ \bproprietary and confidential\b
proprietary ~ 45 ~ 60 ~ unauthorized ~ unauthorized (?:copying|reproduction|distribution) (?:of this file|is (?:strictly )?prohibited)
proprietary ~ 45 ~ 60 ~ written ~ without (?:the )?(?:prior|express) written (?:consent|permission) of
commercial ~ 45 ~ 50 ~ commercial ~ \bcommercial licen[sc]e (?:agreement|is required|key)\b
eula ~ 45 ~ 60 ~ end ~ \bend user licen[sc]e agreement\b
non-commercial ~ 45 ~ 55 ~ commercial ~ \bfor non ?commercial (?:use|purposes) only\b
research-only ~ 45 ~ 55 ~ research ~ \bfor research (?:use|purposes) only\b
copyright ~ 40 ~ 30 ~ copyright ~ \ball rights reserved\b.{0,40}copyright|copyright.{0,60}\ball rights reserved\b
copyright ~ 30 ~ 20 ~ copyright ~ \bcopyright (?:\(c\) )?(?:19|20)\d\d\b
dual ~ 48 ~ 50 ~ dual ~ \bdual licen[sc]ed\b
unknown-license ~ 20 ~ 20 ~ licen ~ \blicen[sc]ed under (?:the )?[\w.+-]+
unknown-license ~ 20 ~ 20 ~ licen|copying ~ \bsee (?:the )?(?:file )?(?:licen[sc]e|copying)(?:\.txt|\.md)?\b
unknown-license ~ 20 ~ 20 ~ permission ~ \bpermission is (?:hereby )?granted\b
unknown-license ~ 15 ~ 10 ~ licen ~ \bunder the terms of the [\w.+-]+ licen[sc]e\b
"""
