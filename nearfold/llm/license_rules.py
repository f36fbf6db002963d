"""The signature rules of the license scan, one a line: label | kind | pattern.

A pattern is written over a text's words (lower case, one space between); groups may
offer words. The word a text must hold before a rule runs is the longest one outside
all groups. Kinds, strongest first, and their weights are in KINDS.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Kind -> (priority, weight). Of equal spans the lower priority number wins.
KINDS = {"tag": (0, 1.0), "text": (1, 0.95), "name": (2, 0.9), "link": (3, 0.85), "short": (4, 0.6)}

# Names, texts and identifiers of public licenses.
TABLE = r"""
mit | tag | spdx license identifier mit
mit | name | mit license
mit | name | (?:expat|x11) license
mit | name | licensed under (?:the )?mit
mit | name | mit (?:expat|style|x11) license
mit | text | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | text | the software is provided as is without warranty of any kind express or implied
mit | text | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | link | opensource org licen[cs]es? mit
mit | link | choosealicense com licenses mit
mit-0 | tag | spdx license identifier mit 0
mit-0 | name | mit no attribution(?: license)?
apache | tag | spdx license identifier apache (?:1 0|1 1|2 0)
apache | name | apache license
apache | name | apache license version (?:1 0|1 1|2 0|2)
apache | name | apache software license(?: version)? (?:1 0|1 1|2 0)
apache | name | apache (?:license )?v2
apache | text | you may not use this file except in compliance with the license
apache | text | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache | text | terms and conditions for use reproduction and distribution
apache | link | www apache org licenses(?: license 2 0)?
apache | link | opensource org licenses apache 2 0
apache | short | apache 2 0
gpl | tag | spdx license identifier gpl (?:1|2|3) 0(?: only| or later)?
gpl | name | general public license
gpl | name | gnu general public license
gpl | name | gnu general public license version (?:1|2|3)
gpl | name | gnu general public license as published by the free software foundation
gpl | name | gnu gpl(?: version)?(?: v?[123])?
gpl | text | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | text | you should have received a copy of the gnu general public license along with this program
gpl | text | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl | text | either version (?:2|3) of the license or at your option any later version
gpl | link | www gnu org licenses(?: old licenses)? gpl(?: [123] 0)?
gpl | link | opensource org licenses gpl (?:2|3) 0
gpl | short | gpl v?[23](?: 0)?
gpl | short | gplv2
gpl | short | gplv3
gpl | short | licensed under (?:the )?gpl
lgpl | tag | spdx license identifier lgpl (?:2 0|2 1|3 0)(?: only| or later)?
lgpl | name | lesser general public license
lgpl | name | gnu lesser general public license(?: version (?:2 1|3))?
lgpl | name | gnu library general public license
lgpl | name | library general public license
lgpl | text | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl | link | www gnu org licenses(?: old licenses)? lgpl(?: (?:2 1|3 0))?
lgpl | short | lgpl v?[23](?: [01])?
lgpl | short | lgplv2
lgpl | short | lgplv3
agpl | tag | spdx license identifier agpl (?:1|3) 0(?: only| or later)?
agpl | name | affero general public license
agpl | name | gnu affero general public license(?: version 3)?
agpl | text | interacting with it remotely through a computer network
agpl | link | www gnu org licenses agpl(?: 3 0)?
agpl | short | agpl v?3(?: 0)?
agpl | short | agplv3
gfdl | tag | spdx license identifier gfdl 1 [123](?: only| or later)?
gfdl | name | free documentation license
gfdl | name | gnu free documentation license(?: version 1 [123])?
gfdl | text | with no invariant sections no front cover texts and no back cover texts
gfdl | link | www gnu org (?:licenses|copyleft) fdl
bsd-2-clause | tag | spdx license identifier bsd 2 clause
bsd-2-clause | name | bsd 2 clause(?: license)?
bsd-2-clause | name | (?:simplified|freebsd) bsd license
bsd-2-clause | name | 2 clause bsd(?: license)?
bsd-2-clause | link | opensource org licenses bsd 2 clause
bsd-3-clause | tag | spdx license identifier bsd 3 clause
bsd-3-clause | name | bsd 3 clause(?: license)?
bsd-3-clause | name | (?:new|modified|revised) bsd license
bsd-3-clause | name | 3 clause bsd(?: license)?
bsd-3-clause | text | neither the name of (?:the copyright holder|the author|the organization) nor the names of its contributors may be used to endorse or promote products
bsd-3-clause | link | opensource org licenses bsd 3 clause
bsd-4-clause | tag | spdx license identifier bsd 4 clause
bsd-4-clause | name | (?:original|old) bsd license
bsd-4-clause | text | all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd | name | bsd license
bsd | name | licensed under (?:the )?bsd
bsd | text | redistribution and use in source and binary forms with or without modification are permitted provided that
bsd | text | redistributions of source code must retain the above copyright notice
bsd | text | redistributions in binary form must reproduce the above copyright notice
0bsd | tag | spdx license identifier 0bsd
0bsd | name | (?:zero clause bsd|bsd zero clause) license
isc | tag | spdx license identifier isc
isc | name | isc license
isc | text | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | link | opensource org licenses isc
mpl | tag | spdx license identifier mpl (?:1 0|1 1|2 0)
mpl | name | mozilla public license
mpl | name | mozilla public license(?: version| v)? (?:1 0|1 1|2 0)
mpl | text | this source code form is subject to the terms of the mozilla public license
mpl | link | (?:www )?mozilla org mpl(?: 2 0| mpl 1 1)?
mpl | short | mpl (?:1 1|2 0)
epl | tag | spdx license identifier epl (?:1|2) 0
epl | name | eclipse public license
epl | name | eclipse public license(?: version| v)? (?:1 0|2 0)
epl | text | this program and the accompanying materials are made available under the terms of the eclipse public license
epl | link | www eclipse org legal epl
edl | name | eclipse distribution license(?: version| v)?(?: 1 0)?
eupl | tag | spdx license identifier eupl 1 [012]
eupl | name | european union public licen[cs]e
eupl | short | eupl(?: v)? ?1 [012]
cddl | tag | spdx license identifier cddl 1 [01]
cddl | name | common development and distribution license
cddl | short | cddl(?: version)? 1 [01]
cpl | name | common public license(?: version)?(?: 1 0)?
ibm-pl | name | ibm public license(?: version)?(?: 1 0)?
cc0 | tag | spdx license identifier cc0 1 0
cc0 | name | cc0(?: 1 0)? universal
cc0 | name | creative commons zero
cc0 | text | to the extent possible under law .{0,80}has waived all copyright
cc0 | link | creativecommons org publicdomain zero 1 0
cc0 | short | cc0
cc-by | tag | spdx license identifier cc by [1234] [05]
cc-by | name | creative commons attribution
cc-by | name | creative commons attribution [1234] [05](?: international| unported| generic)?(?: license)?
cc-by | link | creativecommons org licenses by [1234] [05]
cc-by | short | cc by(?: [1234] [05])?
cc-by-sa | tag | spdx license identifier cc by sa [1234] [05]
cc-by-sa | name | creative commons attribution share ?alike(?: [1234] [05])?
cc-by-sa | link | creativecommons org licenses by sa [1234] [05]
cc-by-sa | short | cc by sa(?: [1234] [05])?
cc-by-nd | tag | spdx license identifier cc by nd [1234] [05]
cc-by-nd | name | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1234] [05])?
cc-by-nd | link | creativecommons org licenses by nd [1234] [05]
cc-by-nd | short | cc by nd(?: [1234] [05])?
cc-by-nc | tag | spdx license identifier cc by nc [1234] [05]
cc-by-nc | name | creative commons attribution non ?commercial(?: [1234] [05])?
cc-by-nc | name | licensed under cc by nc(?: [1234] [05])?
cc-by-nc | link | creativecommons org licenses by nc [1234] [05]
cc-by-nc | short | cc by nc(?: [1234] [05])?
cc-by-nc-sa | tag | spdx license identifier cc by nc sa [1234] [05]
cc-by-nc-sa | name | creative commons attribution non ?commercial share ?alike(?: [1234] [05])?
cc-by-nc-sa | link | creativecommons org licenses by nc sa [1234] [05]
cc-by-nc-sa | short | cc by nc sa(?: [1234] [05])?
cc-by-nc-nd | tag | spdx license identifier cc by nc nd [1234] [05]
cc-by-nc-nd | name | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1234] [05])?
cc-by-nc-nd | link | creativecommons org licenses by nc nd [1234] [05]
cc-by-nc-nd | short | cc by nc nd(?: [1234] [05])?
public-domain | name | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | name | public domain dedication
public-domain | text | this work is in the public domain
public-domain | link | creativecommons org publicdomain mark 1 0
unlicense | tag | spdx license identifier unlicense
unlicense | name | the unlicense
unlicense | text | this is free and unencumbered software released into the public domain
unlicense | link | unlicense org
wtfpl | tag | spdx license identifier wtfpl
wtfpl | name | do what the fuck you want to public license
wtfpl | short | wtfpl(?: version 2)?
zlib | tag | spdx license identifier zlib
zlib | name | zlib(?: libpng)? license
zlib | text | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | text | altered source versions must be plainly marked as such
libpng | name | libpng license
boost | tag | spdx license identifier bsl 1 0
boost | name | boost software license
boost | name | boost software license version 1 0
boost | link | www boost org license 1 0
artistic | tag | spdx license identifier artistic [12] 0
artistic | name | artistic license
artistic | name | artistic license [12] 0
artistic | link | (?:www )?perlfoundation org artistic license 2 0
perl | name | (?:same|under the) terms as perl itself
python | tag | spdx license identifier (?:python|psf) 2 0
python | name | python software foundation license(?: version 2)?
python | name | psf license(?: agreement)?
php | tag | spdx license identifier php 3 0[01]?
php | name | php license(?: version)?(?: 3 0[01]?)?
ruby | tag | spdx license identifier ruby
ruby | name | ruby license
postgresql | tag | spdx license identifier postgresql
postgresql | name | postgresql licen[cs]e
openssl | tag | spdx license identifier openssl
openssl | name | openssl license
openssl | text | this product includes software developed by the openssl project
curl | tag | spdx license identifier curl
curl | name | curl license
ncsa | tag | spdx license identifier ncsa
ncsa | name | university of illinois ncsa open source license
ncsa | name | ncsa open source license
afl | tag | spdx license identifier afl [123] [01]
afl | name | academic free license(?: version)?(?: [123] [01])?
osl | tag | spdx license identifier osl [123] [01]
osl | name | open software license(?: version)?(?: [123] [01])?
ms-pl | tag | spdx license identifier ms pl
ms-pl | name | microsoft public license
ms-rl | tag | spdx license identifier ms rl
ms-rl | name | microsoft reciprocal license
apsl | name | apple public source license(?: version)?(?: [12] [012])?
qpl | name | q public license(?: version)?(?: 1 0)?
sleepycat | name | sleepycat license
vim | name | vim license
tcl | name | tcl tk license
beerware | text | as long as you retain this notice you can do whatever you want with this stuff
beerware | name | beer ?ware license
json | text | the software shall be used for good not evil
json | name | json license
ofl | tag | spdx license identifier ofl 1 [01]
ofl | name | sil open font license(?: version)?(?: 1 [01])?
ofl | link | scripts sil org ofl
lppl | name | latex project public license(?: version)?(?: 1 [0123]c?)?
odbl | tag | spdx license identifier odbl 1 0
odbl | name | open (?:data commons open )?database license(?: v)?(?: ?1 0)?
odbl | link | opendatacommons org licenses odbl
odc-by | name | open data commons attribution license
odc-by | link | opendatacommons org licenses by
pddl | name | public domain dedication and license
cdla | name | community data license agreement(?: permissive| sharing)?
cdla | tag | spdx license identifier cdla (?:permissive|sharing) [12] 0
sspl | tag | spdx license identifier sspl 1 0
sspl | name | server side public license(?: version 1)?
busl | tag | spdx license identifier busl 1 1
busl | name | business source license(?: version)?(?: 1 1)?
elastic | tag | spdx license identifier elastic 2 0
elastic | name | elastic license(?: version)?(?: 2 0)?
polyform | name | polyform (?:noncommercial|strict|shield|small business|perimeter) license
commons-clause | name | commons clause license condition(?: v)?(?: ?1 0)?
openrail | name | open ?rail(?: m)? license
openrail | name | responsible ai license
llama | name | llama [234] community license(?: agreement)?
upl | tag | spdx license identifier upl 1 0
upl | name | universal permissive license(?: v)?(?: ?1 0)?
cecill | tag | spdx license identifier cecill [12] [01]
cecill | name | cecill (?:b|c|free software) license(?: agreement)?
bsl | name | licensed under (?:the )?bsl(?: 1 [01])?
proprietary | text | all rights reserved
proprietary | text | proprietary and confidential
proprietary | text | unauthorized copying of this file via any medium is strictly prohibited
proprietary | text | no part of this (?:publication|book|work) may be reproduced
proprietary | name | end user license agreement
proprietary | name | commercial license
non-commercial | text | for non ?commercial use only
non-commercial | text | for (?:academic|research|personal) use only
see-license | text | see the license file(?: for details)?
see-license | text | see (?:copying|license)(?: txt| md)? for (?:details|more information)
see-license | short | license file
generic | short | released under the .{1,40} license
generic | short | open source license
generic | short | free software license
"""


@dataclass(frozen=True)
class LicenseRule:
    number: int
    label: str
    kind: str
    pattern: str
    keyword: str
    priority: int
    weight: float


def keyword(pattern: str) -> str:
    """The longest plain word outside all groups, which every match must hold.

    `~` marks where a word may go on: into a group, or past an optional space.
    """
    bare, depth, last = [], 0, ""
    flat = pattern.replace(" ?", "~")
    for i, c in enumerate(flat):
        if c == "(":
            bare.append(" " if flat[i + 3 : i + 4] == " " else "~")
        depth += (c == "(") - (c == ")")
        if c == ")":
            bare.append(" " if last == " " else "~")
            bare.append(" " if flat[i + 1 : i + 3] in ("", "?", "? ") or flat[i + 1 : i + 2] == " " else "")
        elif not depth and c != "?":
            bare.append(c)
        last = c
    words = [w for w in "".join(bare).split() if re.fullmatch("[a-z0-9]+", w)]
    if not words:
        raise ValueError(f"no plain word in {pattern!r}")
    return max(words, key=lambda w: (len(w), w))


def over_words(pattern: str) -> str:
    """The pattern over text in which each word has a space of its own on either side.

    A space becomes two; ` ?` lets the words on both sides be one word.
    """
    return " " + pattern.replace(" ?", "(?: )?").replace(" ", "  ") + " "


def parse(text: str) -> list[LicenseRule]:
    rules = []
    for line in text.strip().splitlines():
        label, kind, pattern = (x.strip() for x in line.split("|", 2))
        priority, weight = KINDS[kind]
        rules.append(LicenseRule(len(rules), label, kind, over_words(pattern), keyword(pattern), priority, weight))
    return rules


RULES = parse(TABLE)
