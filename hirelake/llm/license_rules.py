"""Signature rules for licence texts, written for words in lower case joined by one space.

Each line: label, keyword, title, address, notice, separated by ``|``; ``-`` stands for none. The keyword (a plain string
that any match of the line's patterns contains) gates the patterns; a pattern that need not contain it has a keyword of its
own before ``=>``. A pattern matches whole words. For each label there is
also a rule for its machine-readable tag, made from the label itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Kind: priority and confidence. Of overlapping detections the one with the higher priority decides.
KINDS = {"tag": (4, 1.0), "title": (3, 0.9), "address": (2, 0.95), "notice": (1, 0.8), "generic": (0, 0.5)}

LINES = r"""
mit | mit | (?:the )?mit (?:license|licence)(?: mit)? | (?:www )?opensource org licenses? mit(?: license)?(?: php| html)? | licensed under (?:the )?(?:terms of (?:the )?)?mit
mit-0 | mit | mit no attribution(?: license)? | (?:github com )?aws mit 0 | licensed under (?:the )?mit 0
x11 | x11 | (?:the )?x11 license | (?:www )?opensource org licenses? x11 | (?:under|mit) (?:the )?x11 (?:style )?license
expat | expat | (?:the )?expat license | - | (?:under|terms of) the expat license
isc | isc | (?:the )?isc (?:license|licence) | (?:www )?isc org (?:downloads software support policy|licenses?) | licensed under (?:the )?isc
apache-1.0 | apache | apache (?:software )?license (?:version )?1 0 | (?:www )?apache org licenses license 1 0 | developed by the apache group for use in the apache http server
apache-1.1 | apache | apache (?:software )?license (?:version )?1 1 | (?:www )?apache org licenses license 1 1 | developed by the apache software foundation
apache-2.0 | apache | apache (?:software )?license(?: version)? v? ?2(?: 0)? | (?:www )?apache org licenses license 2 0(?: txt| html)? | licensed under (?:the )?apache license
bsd-2-clause | bsd | (?:(?:simplified|2 clause|two clause) bsd|freebsd|bsd 2 clause) license | (?:www )?opensource org licenses? bsd 2 clause | licensed under (?:the )?(?:simplified|2 clause|two clause) bsd
bsd-3-clause | bsd | (?:(?:new|modified|revised|3 clause|three clause) bsd|bsd 3 clause) license | (?:www )?opensource org licenses? bsd 3 clause | licensed under (?:the )?(?:new|modified|3 clause|three clause) bsd
bsd-4-clause | bsd | (?:(?:original|old|4 clause|four clause) bsd|bsd 4 clause) license | directory fsf org wiki license bsd 4clause | licensed under (?:the )?(?:original|4 clause|four clause) bsd
bsd-0-clause | bsd | (?:zero clause bsd|bsd zero clause|0bsd)(?: license)? | - | licensed under (?:the )?zero clause bsd
bsd | bsd | (?:the )?bsd (?:style )?(?:license|licence) | (?:www )?opensource org licenses? bsd license(?: php)? | (?:licensed|released|distributed) under (?:a |the )?bsd
gpl-1.0 | general public | (?:gnu )?general public license(?: version)? v? ?1(?: 0)? | - | -
gpl-2.0 | general public | (?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? v? ?2(?: 0)? | - | version 2 of the (?:gnu )?general public license
gpl-3.0 | general public | (?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: version)? v? ?3(?: 0)? | - | version 3 of the (?:gnu )?general public license
gpl | gpl | (?:gnu )?gpl (?:license|licence) | (?:www )?gnu org (?:licenses|copyleft) gpl(?: txt| html)? | (?:licensed|released|distributed) under (?:the )?(?:gnu )?gpl
gpl-2.0-only | gpl | gplv2(?: only)? | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0[a-z ]{0,12} | (?:licensed|released) under (?:the )?gpl (?:version |v )?2
gpl-3.0-only | gpl | gplv3(?: only)? | (?:www )?gnu org licenses gpl 3 0[a-z ]{0,12} | (?:licensed|released) under (?:the )?gpl (?:version |v )?3
gpl-2.0-or-later | later version | general public license [a-z0-9 ]{0,80}version 2 (?:of the license )?or (?:at your option )?any later version | - | either version 2 of the license or at your option any later version
gpl-3.0-or-later | later version | general public license [a-z0-9 ]{0,80}version 3 (?:of the license )?or (?:at your option )?any later version | - | either version 3 of the license or at your option any later version of the general public license
lgpl-2.0 | general public | (?:gnu )?library general public license(?:(?: version)? v? ?2(?: 0)?)? | - | terms of the gnu library general public license
lgpl-2.1 | lesser | (?:gnu )?lesser general public license(?: version)? v? ?2 1 | lgpl => (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: (?:txt|html|en|standalone))* | version 2 1 of the (?:gnu )?lesser general public license
lgpl-3.0 | lesser | (?:gnu )?lesser general public license(?: version)? v? ?3(?: 0)? | (?:www )?gnu org licenses lesser[a-z ]{0,6} | version 3 of the (?:gnu )?lesser general public license
lgpl | lgpl | (?:gnu )?lgpl(?: ?v?[23](?: [01])?)? (?:license|licence) | (?:www )?gnu org (?:licenses|copyleft) lgpl[a-z0-9 ]{0,8} | (?:licensed|released) under (?:the )?(?:gnu )?lgpl
lesser-gpl | lesser | (?:gnu )?lesser general public license | - | terms of the (?:gnu )?lesser general public license
agpl-1.0 | affero | affero general public license(?: version)? v? ?1(?: 0)? | (?:www )?affero org oagpl html | -
agpl-3.0 | affero | (?:gnu )?affero general public license(?:(?: version)? v? ?3(?: 0)?)? | agpl => (?:www )?gnu org licenses agpl 3 0(?: (?:txt|html|en|standalone))* | terms of the (?:gnu )?affero general public license
agpl | agpl | (?:gnu )?agpl(?: ?v?3(?: 0)?)? (?:license|licence) | (?:www )?gnu org licenses agpl[a-z0-9 ]{0,8} | (?:licensed|released) under (?:the )?(?:gnu )?agpl
gfdl-1.1 | documentation license | (?:gnu )?free documentation license(?: version)? v? ?1 1 | - | -
gfdl-1.2 | documentation license | (?:gnu )?free documentation license(?: version)? v? ?1 2 | - | -
gfdl-1.3 | documentation license | (?:gnu )?free documentation license(?: version)? v? ?1 3 | - | -
gfdl | documentation license | (?:gnu )?free documentation license | - | terms of the gnu free documentation license
mpl-1.0 | mozilla | mozilla public license(?: version)? v? ?1 0 | (?:www )?mozilla org mpl mpl 1 0[a-z ]{0,6} | -
mpl-1.1 | mozilla | mozilla public license(?: version)? v? ?1 1 | (?:www )?mozilla org mpl mpl 1 1[a-z ]{0,6} | subject to the mozilla public license version 1 1
mpl-2.0 | mozilla | mozilla public license(?: version)? v? ?2(?: 0)? | (?:www )?mozilla org mpl 2 0 | subject to the terms of the mozilla public license
mpl | mozilla | mozilla public license | (?:www )?mozilla org mpl | licensed under the mozilla
epl-1.0 | eclipse | eclipse public license(?: version)? v? ?1(?: 0)? | (?:www )?eclipse org (?:legal|org documents) epl v ?10(?: html)? | -
epl-2.0 | eclipse | eclipse public license(?: version)? v? ?2(?: 0)? | (?:www )?eclipse org (?:legal|org documents) epl (?:2 0|v ?20)(?: html)? | terms of the eclipse public license
edl-1.0 | eclipse | eclipse distribution license(?: version)? v? ?1 0 | (?:www )?eclipse org org documents edl v ?10(?: php| html)? | -
cddl-1.0 | common development | common development and distribution license(?:(?: version)? v? ?1 0)? | - | terms of the common development and distribution license
cddl-1.1 | common development | common development and distribution license(?: version)? v? ?1 1 | - | -
cddl | cddl | cddl(?: ?v?1(?: [01])?)? (?:license|licence) | (?:www )?(?:sun|opensource) (?:com|org) (?:cddl|licenses? cddl)[a-z0-9 ]{0,6} | licensed under (?:the )?cddl
cpl-1.0 | common public | common public license(?:(?: version)? v? ?1 0)? | ibm com developerworks => (?:www )?ibm com developerworks library os cpl(?: html)? | terms of the common public license
ipl-1.0 | ibm public | ibm public license(?:(?: version)? v? ?1 0)? | - | terms of the ibm public license
artistic-1.0 | artistic | (?:the )?artistic license(?: version)? v? ?1(?: 0)? | (?:www )?perlfoundation org artistic license 1 0 | -
artistic-2.0 | artistic | (?:the )?artistic license(?: version)? v? ?2(?: 0)? | (?:www )?perlfoundation org artistic license 2 0 | terms of the artistic license
artistic | artistic | (?:the )?(?:perl )?artistic license | dev perl org licenses artistic(?: html)? | same terms as perl itself [a-z ]{0,30}artistic
zlib | zlib | (?:the )?zlib(?: libpng)? license | (?:www )?(?:zlib net|gzip org zlib) zlib license(?: html)? | licensed under (?:the )?zlib
libpng | libpng | (?:the )?libpng license | (?:www )?libpng org pub png src libpng license(?: txt)? | distributed (?:according to|under) (?:the )?[a-z ]{0,30}libpng
boost-1.0 | boost | boost software license(?:(?: version)? v? ?1 0)? | (?:www )?boost org license 1 0(?: txt)? | distributed under the boost software license
unlicense | unlicense | (?:the )?unlicense | (?:www )?unlicense org | (?:released|dedicated) [a-z ]{0,30}unlicense
wtfpl | wtf | wtfpl(?:(?: version)? v? ?2)? | (?:www )?wtfpl net | do what the f => do what the f[a-z]{1,3} you want to public license(?:(?: version)? v? ?2)?
public-domain | public domain | public domain dedication | - | (?:released|placed|dedicated|put)(?: it| this [a-z]+)? (?:in|into|to) the public domain
cc0-1.0 | cc0 | cc0(?:(?: version)? ?1 0)?(?: universal)?(?: license)? | creativecommons org publicdomain zero 1 0 [a-z ]{0,12}cc0 | (?:waived|dedicated|released) [a-z ]{0,40}cc0
cc-zero | creativecommons | - | (?:www )?creativecommons org publicdomain zero 1 0 | -
cc-mark | creativecommons | - | (?:www )?creativecommons org publicdomain mark 1 0 | -
cc-by-1.0 | cc by | cc by 1 0 | - | -
cc-by-2.0 | cc by | cc by 2 0 | - | -
cc-by-2.5 | cc by | cc by 2 5 | - | -
cc-by-3.0 | cc by | cc by 3 0(?: unported)? | - | -
cc-by-4.0 | cc by | cc by 4 0(?: international)? | - | -
cc-by-sa-2.0 | cc by sa | cc by sa 2 0 | - | -
cc-by-sa-3.0 | cc by sa | cc by sa 3 0(?: unported)? | - | -
cc-by-sa-4.0 | cc by sa | cc by sa 4 0(?: international)? | - | -
cc-by-nc-4.0 | cc by nc | cc by nc 4 0(?: international)? | - | -
cc-by-nd-4.0 | cc by nd | cc by nd 4 0(?: international)? | - | -
cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0(?: international)? | - | -
cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0(?: international)? | - | -
cc-by | creative | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? license | (?:www )?creativecommons org licenses by [1-4] [05] [a-z ]{0,20}creative | licensed under (?:a |the )?creative commons attribution(?: [1-4] [05])?
cc-by-sa | creative | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license)? | - | licensed under (?:a |the )?creative commons attribution share ?alike
cc-by-nc | creative | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: license)? | - | licensed under (?:a |the )?creative commons attribution non ?commercial
cc-by-nd | creative | creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: license)? | - | licensed under (?:a |the )?creative commons attribution no ?deriv(?:ative)?s?
cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: license)? | - | -
cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported)?(?: license)? | - | -
cc-by-url | creativecommons | - | (?:www )?creativecommons org licenses by [1-4] [05] | -
cc-by-sa-url | creativecommons | - | (?:www )?creativecommons org licenses by sa [1-4] [05] | -
cc-by-nc-url | creativecommons | - | (?:www )?creativecommons org licenses by nc [1-4] [05] | -
cc-by-nd-url | creativecommons | - | (?:www )?creativecommons org licenses by nd [1-4] [05] | -
cc-by-nc-sa-url | creativecommons | - | (?:www )?creativecommons org licenses by nc sa [1-4] [05] | -
cc-by-nc-nd-url | creativecommons | - | (?:www )?creativecommons org licenses by nc nd [1-4] [05] | -
odbl-1.0 | open d | open database license(?:(?: version)? v? ?1 0)? | opendatacommons org licenses odbl [a-z0-9 ]{0,6}open database | made available under the open database license
odc-by-1.0 | open d | open data commons attribution license(?:(?: version)? v? ?1 0)? | - | made available under the open data commons attribution license
pddl-1.0 | open d | open data commons public domain dedication(?: and)? license(?: 1 0)? | - | -
odc-url | opendatacommons | - | (?:www )?opendatacommons org licenses (?:odbl|by|pddl)(?: 1 0| summary)? | -
eupl-1.1 | european union public | european union public licen[cs]e(?: version)? v? ?1 1 | - | -
eupl-1.2 | european union public | european union public licen[cs]e(?: version)? v? ?1 2 | - | -
eupl | eupl | eupl(?: ?v?1 [12])? (?:license|licence) | joinup ec europa eu [a-z ]{0,30}eupl[a-z ]{0,10} | licensed under (?:the )?eupl
ms-pl | microsoft public | microsoft public license(?: ms pl)? | - | terms of the microsoft public license
ms-rl | microsoft reciprocal | microsoft reciprocal license(?: ms rl)? | - | terms of the microsoft reciprocal license
osl-3.0 | open software license | open software license(?: version)? v? ?3(?: 0)? | - | licensed under the open software license version 3 0
osl | open software license | open software license | - | licensed under the open software license
afl-3.0 | academic free | academic free license(?: version)? v? ?3(?: 0)? | - | licensed under the academic free license version 3 0
afl | academic free | academic free license | - | licensed under the academic free license
ncsa | ncsa | (?:university of illinois )?ncsa open source license | (?:www )?otm illinois edu [a-z ]{0,20}ncsa[a-z ]{0,10} | licensed under the [a-z ]{0,30}ncsa
illinois-ncsa | university of illinois | university of illinois open source license | - | terms of the university of illinois open source license
python-2.0 | python | python software foundation license(?:(?: version)? v? ?2(?: 0)?)? | (?:www )?python org (?:psf license|[a-z0-9 ]{0,12}license) | licensed to => licensed to (?:the )?psf under a contributor agreement
psf | psf | psf license(?: agreement)? | docs python org => docs python org (?:[23] )?license(?: html)? | licensed under (?:the )?psf
cnri-python | cnri | cnri (?:python )?(?:open source )?license(?: agreement)? | (?:www )?python org [a-z0-9 ]{0,20}cnri[a-z ]{0,10} | corporation for national => corporation for national research initiatives
ruby | ruby | (?:the )?ruby license | (?:www )?ruby lang org [a-z ]{0,12}license[a-z ]{0,6} | same terms as ruby(?: itself)?
perl | perl | (?:the )?perl license | dev perl org licenses? | same terms as (?:the )?perl(?: 5)?(?: itself| programming language)?
php-3.01 | php | php license(?: version)? v? ?3 01 | (?:www )?php net license 3 01(?: txt)? | subject to version 3 01 of the php license
php-3.0 | php | php license(?: version)? v? ?3 0 | (?:www )?php net license 3 0(?: txt)? | subject to version 3 0 of the php license
zend-2.0 | zend | zend(?: engine)? license(?:(?: version)? v? ?2(?: 0)?)? | (?:www )?zend com license 2 00(?: txt)? | subject to version 2 00 of the zend license
openssl | openssl | (?:the )?openssl license | (?:www )?openssl org source license(?: html)? | developed by the openssl project
ssleay | ssleay | (?:original )?ssleay license | - | eric young => cryptographic software written by eric young(?: eay cryptsoft com)?
w3c | w3c | w3c(?: software)?(?: notice and)? license | w3 org => (?:www )?w3 org consortium legal(?: [0-9]{4})? copyright software(?: [0-9]{8}| and document)?(?: html)? | licensed under (?:the )?w3c
unicode | unicode | unicode (?:inc )?license(?: agreement)? | (?:www )?unicode org (?:copyright|license)(?: html| txt)? | distributed under the (?:terms of use in )?[a-z ]{0,20}unicode
icu | icu | icu license(?: icu 1 8 1 and later)? | source icu project org [a-z ]{0,20}license[a-z ]{0,6} | licensed under (?:the )?icu
ofl-1.1 | open font | sil open font license(?:(?: version)? v? ?1 1)? | scripts sil org ofl [a-z ]{0,10}open font | licensed under the sil open font license
ofl | ofl | sil ofl(?: 1 [01])? | scripts sil org ofl | licensed under (?:the )?(?:sil )?ofl
lppl-1.3c | latex project | latex project public license(?: version)? v? ?1 3c? | (?:www )?latex project org lppl(?: txt)? | conditions of the latex project public license
lppl | lppl | lppl(?: ?1 [0-3][abc]?)? (?:license|licence) | - | licensed under (?:the )?lppl
postgresql | postgresql | (?:the )?postgresql license | (?:www )?postgresql org about licen[cs]e | licensed under (?:the )?postgresql
ftl | freetype | freetype (?:project )?license | (?:www )?freetype org [a-z ]{0,12}license[a-z ]{0,6} | portions of this software are copyright [a-z0-9 ]{0,20}the freetype project
ijg | jpeg | independent jpeg group(?: s)? license | ijg org => (?:www )?ijg org | based in part on the work of the independent jpeg group
curl | curl | (?:the )?curl license | curl (?:haxx )?se docs copyright(?: html)? | licensed under (?:the )?curl
vim | vim | (?:the )?vim license | (?:www )?vim org [a-z ]{0,12}license[a-z ]{0,6} | distributed under the vim license
upl-1.0 | universal permissive | universal permissive license(?:(?: version)? v? ?1 0)? | - | licensed under the universal permissive license
bcl | binary code license | (?:oracle |sun )?binary code license(?: agreement)? | - | -
apsl-2.0 | apple public source | apple public source license(?:(?: version)? v? ?[12](?: [0-2])?)? | - | subject to the apple public source license
npl-1.1 | netscape public | netscape public license(?:(?: version)? v? ?1 [01])? | - | subject to the netscape public license
qpl-1.0 | q public | q public license(?:(?: version)? v? ?1 0)? | - | terms of the q public license
rpl-1.5 | reciprocal public | reciprocal public license(?:(?: version)? v? ?1 [15])? | - | -
sleepycat | sleepycat | (?:the )?sleepycat(?: public)? license | - | copyright [a-z0-9 ]{0,20}sleepycat software
sissl | sun industry standards | sun industry standards source license(?:(?: version)? v? ?1 [12])? | - | -
nokia | nokia | nokia open source license | - | -
watcom-1.0 | watcom | (?:sybase )?open watcom public license(?: 1 0)? | - | -
bsl-1.1 | business source | business source license(?:(?: version)? v? ?1 1)? | bsl11 => (?:www )?mariadb com bsl11 | licensed under the business source license
sspl-1.0 | server side public | server side public license(?:(?: version)? v? ?1)? | - | licensed under the server side public license
elastic-2.0 | elastic | elastic license(?:(?: version)? v? ?2(?: 0)?)? | (?:www )?elastic co licensing elastic license | licensed under the elastic license
commons-clause | commons clause | commons clause(?: license condition)?(?: v1 0)? | - | -
polyform-nc | polyform | polyform (?:noncommercial|small business|strict) license(?: 1 0 0)? | polyformproject => (?:www )?polyformproject org licenses (?:noncommercial|small business|strict)(?: 1 0 0)? | licensed under (?:the )?polyform
mulan-2.0 | mulan | mulan (?:psl|permissive software license)(?: v?2)? | license coscl org cn mulanpsl2? | licensed under (?:the )?mulan psl
hippocratic | hippocratic | hippocratic license(?: [1-3] [01])? | firstdonoharm => firstdonoharm dev | -
openrail | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: [mds])? license | - | licensed under (?:the )?[a-z ]{0,20}openrail
proprietary | proprietary | proprietary and confidential | - | unauthorized copying => unauthorized copying of this file
all-rights | rights reserved | all rights reserved | - | (?:c|copyright) (?:19|20)[0-9]{2} [a-z ]{0,40}all rights reserved
mit-text | permission is hereby | - | - | permission is hereby granted free of charge to any person obtaining a copy
isc-text | permission to use | - | - | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-text | redistribution and use | - | - | redistribution and use in source and binary forms with or without modification are permitted
apache-text | compliance with the license | - | - | you may not use this file except in compliance with the license
gpl-text | free software | - | - | this program is free software you can redistribute it and or modify it
lgpl-text | free software | - | - | this library is free software you can redistribute it and or modify it
no-warranty | warrant | - | - | (?:without warranty of any kind|without any warranty|provided as is without warranty)
"""


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    kind: str
    keyword: str
    pattern: re.Pattern

    @property
    def priority(self) -> int:
        return KINDS[self.kind][0]

    @property
    def confidence(self) -> float:
        return KINDS[self.kind][1]


def words_of(text: str) -> str:
    return " ".join(re.findall(r"[0-9a-z]+", text.lower()))


def rules(lines: str = LINES) -> list[Rule]:
    """All rules in order: the tag, title, address and notice of each line; at last the general ones."""
    made: list[tuple[str, str, str, str]] = []
    for line in filter(None, map(str.strip, lines.split("\n"))):
        # Alternatives inside a pattern have no blanks around their bar.
        label, keyword, *patterns = line.split(" | ")
        made.append((label, "tag", "spdx license identifier", f"spdx license identifier {words_of(label)}"))
        for kind, pattern in zip(("title", "address", "notice"), patterns, strict=True):
            if pattern != "-":
                own, _, rest = pattern.rpartition(" => ")
                made.append((label, kind, own or keyword, rest))
    made.append(("other", "generic", "licen", r"licen[cs]ed? (?:under|by|to) [a-z0-9 ]{1,20}licen[cs]e"))
    made.append(("other", "generic", "spdx license identifier", "spdx license identifier [a-z0-9]+"))
    return [
        Rule(order, label, kind, keyword, re.compile(f"(?<![^ ])(?:{pattern})(?![^ ])".encode()))
        for order, (label, kind, keyword, pattern) in enumerate(made)
    ]
