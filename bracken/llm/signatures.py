"""Signatures of licences and notices, one hand-written regex a line, over lower-case words joined by blanks.

A line is `label | priority | confidence | keywords | regex`. Higher priorities decide first: 5 the wording of a licence or an
SPDX tag, 4 a grant in a sentence, 3 a name with its version, 2 a name, 1 a hint. A text is matched against a rule only if it
holds all of its keywords as words, or as the beginning of a word if the keyword ends in `*`.
"""

TABLE = r"""
agpl | 5 | 0.99 | spdx agpl* | spdx license identifier agpl ?3 0(?: or later| only)?
agpl | 5 | 0.97 | affero remote* | gnu affero general public licen[sc]e (?:\S+ ){0,12}remote network interaction
agpl | 5 | 0.97 | affero redistribute | redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e
agpl | 4 | 0.96 | affero under | under (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero general public licen[sc]e
agpl | 4 | 0.97 | agpl* licen* | licen[sc]ed under (?:the )?(?:gnu )?agpl ?v?[123]?(?: 0)?(?: or later| only)?
agpl | 3 | 0.95 | affero version | affero general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version [123]
agpl | 2 | 0.9 | affero | (?:gnu )?affero general public licen[sc]e
agpl | 2 | 0.85 | agpl* | agpl ?v?[123]?(?: 0)?(?: or later| only)?
lgpl | 5 | 0.99 | spdx lgpl* | spdx license identifier lgpl ?[23] [01](?: or later| only)?
lgpl | 5 | 0.97 | lesser redistribute | redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e
lgpl | 5 | 0.97 | library redistribute gnu | redistribute it and or modify it under the terms of the gnu library general public licen[sc]e
lgpl | 4 | 0.96 | lesser under | under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lesser general public licen[sc]e
lgpl | 4 | 0.97 | lgpl* licen* | licen[sc]ed under (?:the )?(?:gnu )?lgpl ?v?[23]?(?: [01])?(?: or later| only)?
lgpl | 3 | 0.95 | lesser version | lesser general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version (?:2 1|3)
lgpl | 2 | 0.9 | lesser | (?:gnu )?lesser general public licen[sc]e
lgpl | 2 | 0.9 | library gnu | gnu library general public licen[sc]e
lgpl | 2 | 0.85 | lgpl* | lgpl ?v?[23]?(?: [01])?(?: or later| only| plus)?
gpl | 5 | 0.99 | spdx gpl* | spdx license identifier gpl ?[123] 0(?: or later| only)?
gpl | 5 | 0.95 | redistribute program | this program is free software you can redistribute it and or modify it
gpl | 5 | 0.95 | redistribute general | redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl | 5 | 0.9 | merchantability general | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e
gpl | 5 | 0.9 | received general copy | you should have received a copy of the gnu general public licen[sc]e
gpl | 5 | 0.95 | copyleft general | the gnu general public licen[sc]e is a free copyleft licen[sc]e
gpl | 4 | 0.96 | general under | under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[sc]e
gpl | 4 | 0.97 | gpl* licen* | licen[sc]ed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl ?v?[123]?(?: 0)?(?: or later| only)?
gpl | 4 | 0.95 | gpl* under | (?:released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl ?v?[123]?(?: 0)?
gpl | 3 | 0.95 | general version | gnu general public licen[sc]e (?:as published by the free software foundation )?(?:either )?version [123]
gpl | 3 | 0.9 | gpl* compatible | gpl ?v?[23]? compatible
gpl-exception | 4 | 0.9 | classpath exception | (?:gnu )?classpath(?: linking)? exception
gpl-exception | 4 | 0.9 | runtime exception | gcc runtime library exception
gpl-exception | 4 | 0.85 | bison exception | bison exception
gpl-exception | 4 | 0.85 | exception special link* | special (?:linking )?exception (?:\S+ ){0,12}link(?:ing)?
gpl | 2 | 0.9 | general gnu | gnu general public licen[sc]e
gpl | 2 | 0.8 | gpl* | gpl ?v?[123]?(?: 0)?(?: or later| only)?
gfdl | 5 | 0.99 | spdx gfdl* | spdx license identifier gfdl ?1 [123](?: or later| only)?
gfdl | 5 | 0.95 | invariant cover | no invariant sections (?:with )?no front cover texts(?: and (?:with )?no back cover texts)?
gfdl | 4 | 0.95 | documentation copy | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
gfdl | 2 | 0.9 | documentation | gnu free documentation licen[sc]e
gfdl | 2 | 0.8 | gfdl* | gfdl ?(?:v?1 [123])?
apache | 5 | 0.99 | spdx apache | spdx license identifier apache [12] [01]
apache | 5 | 0.97 | apache compliance | you may not use this (?:file|software|work) except in compliance with the licen[sc]e (?:\S+ ){0,12}apache
apache | 5 | 0.95 | apache org licenses | www apache org licenses license 2 0
apache | 5 | 0.9 | compliance except | may not use this file except in compliance with the licen[sc]e
apache | 5 | 0.9 | conditions kind express | distributed on an as is basis without warranties or conditions of any kind either express or implied
apache | 5 | 0.9 | apache foundation contributor | licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements
apache | 4 | 0.97 | apache* licen* | licen[sc]ed under (?:the )?(?:terms of )?(?:the )?apache(?: software)? ?(?:licen[sc]e)?(?: ?(?:version |v)?[12](?: [01])?)?
apache | 4 | 0.97 | apache2* licen* | licen[sc]ed under (?:the )?apache2(?: 0)?(?: licen[sc]e)?
apache | 4 | 0.95 | apache under | (?:released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[sc]e
apache | 3 | 0.95 | apache licen* | apache(?: software)? licen[sc]e (?:version |v ?)[12](?: [01])?
apache | 3 | 0.9 | apache* | apache ?(?:v ?)?[12](?: [01])?
apache | 2 | 0.9 | apache | apache(?: software)? licen[sc]e
mit | 5 | 0.99 | spdx mit | spdx license identifier mit(?: 0)?
mit | 5 | 0.97 | hereby charge copy | permission is hereby granted free of charge to any person obtaining a copy
mit | 5 | 0.95 | merge sublicense | without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies
mit | 5 | 0.95 | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 5 | 0.9 | noninfringement merchantability | warranties of merchantability fitness for a particular purpose and noninfringement
mit | 5 | 0.9 | tort dealings | an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software
mit | 4 | 0.97 | mit licen* | licen[sc]ed under (?:the )?(?:terms of )?(?:the )?mit(?: licen[sc]e)?
mit | 4 | 0.95 | mit under | (?:released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?mit licen[sc]e
mit-0 | 3 | 0.9 | mit attribution | mit no attribution(?: licen[sc]e)?
mit | 2 | 0.9 | mit | (?:the )?mit(?: x11)? licen[sc]e
mit | 2 | 0.85 | expat | expat licen[sc]e
x11 | 5 | 0.9 | advertising x consortium | the name of the x consortium shall not be used in advertising
x11 | 2 | 0.85 | x11 | x11 licen[sc]e
bsd | 5 | 0.99 | spdx bsd | spdx license identifier bsd [0234] clause(?: clear| patent)?
bsd | 5 | 0.97 | redistribution binary | redistribution and use in source and binary forms with or without modification
bsd | 5 | 0.95 | redistributions retain | redistributions of source code must retain the above copyright notice
bsd | 5 | 0.95 | redistributions reproduce | redistributions in binary form must reproduce the above copyright notice
bsd | 5 | 0.95 | endorse promote | neither the name (?:\S+ ){0,12}nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | 5 | 0.95 | advertising materials software | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd | 5 | 0.9 | regents california | copyright (?:c )?(?:[12][0-9]{3} )*the regents of the university of california
bsd | 4 | 0.97 | bsd licen* | licen[sc]ed under (?:the |a )?(?:terms of )?(?:the )?(?:new |modified |simplified |original )?(?:[0234] clause )?bsd(?: [0234] clause)?(?: licen[sc]e)?
bsd | 4 | 0.95 | bsd style | bsd style licen[sc]e
bsd-3-clause | 3 | 0.95 | bsd clause 3 | (?:bsd 3 clause|3 clause bsd)(?: licen[sc]e)?
bsd-2-clause | 3 | 0.95 | bsd clause 2 | (?:bsd 2 clause|2 clause bsd)(?: licen[sc]e)?
bsd-4-clause | 3 | 0.95 | bsd clause 4 | (?:bsd 4 clause|4 clause bsd)(?: licen[sc]e)?
0bsd | 3 | 0.95 | bsd zero clause | (?:bsd zero clause|zero clause bsd)(?: licen[sc]e)?
0bsd | 2 | 0.85 | 0bsd | 0bsd(?: licen[sc]e)?
bsd | 3 | 0.9 | bsd simplified | simplified bsd licen[sc]e
bsd | 3 | 0.9 | bsd revised | revised bsd licen[sc]e
bsd | 2 | 0.9 | bsd | (?:new |modified |original )?bsd licen[sc]e
mpl | 5 | 0.99 | spdx mpl* | spdx license identifier mpl [12] [01](?: no copyleft exception)?
mpl | 5 | 0.97 | mozilla subject source form | this source code form is subject to the terms of the mozilla public licen[sc]e
mpl | 5 | 0.95 | mpl* obtain | if a copy of the mpl was not distributed with this file you can obtain one
mpl | 4 | 0.95 | mozilla under | under (?:the )?(?:terms of )?(?:the )?mozilla public licen[sc]e
mpl | 4 | 0.97 | mpl* licen* | licen[sc]ed under (?:the )?mpl ?v?[12]?(?: [01])?
mpl | 3 | 0.95 | mozilla public | mozilla public licen[sc]e (?:version |v ?)[12](?: [01])?
mpl | 2 | 0.9 | mozilla | mozilla public licen[sc]e
mpl | 2 | 0.85 | mpl* | mpl ?v?[12](?: [01])?
npl | 2 | 0.9 | netscape | netscape public licen[sc]e
epl | 5 | 0.99 | spdx epl* | spdx license identifier epl [12] 0
epl | 5 | 0.95 | accompanying eclipse | this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e
epl | 4 | 0.97 | epl* licen* | licen[sc]ed under (?:the )?epl ?v?[12]?(?: 0)?
epl | 3 | 0.95 | eclipse licen* | eclipse public licen[sc]e (?:version |v ?)[12](?: 0)?
epl | 2 | 0.9 | eclipse public | eclipse public licen[sc]e
epl | 2 | 0.85 | epl* | epl ?v?[12](?: 0)?
edl | 2 | 0.9 | eclipse distribution | eclipse distribution licen[sc]e
cddl | 5 | 0.99 | spdx cddl* | spdx license identifier cddl 1 [01]
cddl | 5 | 0.95 | development subject | subject to the terms of the common development and distribution licen[sc]e
cddl | 2 | 0.9 | development common | common development and distribution licen[sc]e
cddl | 2 | 0.85 | cddl* | cddl(?: ?v?1 [01])?
cpl | 2 | 0.9 | common public | common public licen[sc]e(?: (?:version |v ?)1 0)?
cpal | 2 | 0.9 | common attribution | common public attribution licen[sc]e
ipl | 2 | 0.9 | ibm public | ibm public licen[sc]e
eupl | 5 | 0.99 | spdx eupl* | spdx license identifier eupl 1 [012]
eupl | 3 | 0.95 | european union | european union public licen[sc]e(?: (?:version |v ?)1 [012])?
eupl | 2 | 0.85 | eupl* | eupl(?: ?v?1 [012])?
isc | 5 | 0.99 | spdx isc | spdx license identifier isc
isc | 5 | 0.95 | fee permission hereby | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
isc | 5 | 0.9 | fee purpose copy | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee
isc | 2 | 0.9 | isc | (?:the )?isc licen[sc]e
zlib | 5 | 0.99 | spdx zlib* | spdx license identifier zlib
zlib | 5 | 0.95 | misrepresented origin | the origin of this software must not be misrepresented
zlib | 5 | 0.9 | altered plainly | altered source versions must be plainly marked as such
zlib | 5 | 0.85 | warranty held | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 2 | 0.9 | zlib* | zlib(?: libpng)? licen[sc]e
libpng | 2 | 0.9 | libpng | libpng licen[sc]e
boost | 5 | 0.99 | spdx bsl | spdx license identifier bsl 1 0
boost | 5 | 0.95 | boost distributed | distributed under the boost software licen[sc]e
boost | 3 | 0.95 | boost licen* | boost software licen[sc]e (?:version |v ?)1 0
boost | 2 | 0.9 | boost | boost(?: software)? licen[sc]e
boost | 2 | 0.7 | bsl | bsl 1 0
artistic | 5 | 0.99 | spdx artistic | spdx license identifier artistic [12] 0
artistic | 4 | 0.9 | perl same terms | under the same terms as perl(?: itself)?
artistic | 3 | 0.95 | artistic licen* | artistic licen[sc]e (?:version |v ?)?[12] 0
artistic | 2 | 0.9 | artistic | (?:the )?(?:perl )?artistic licen[sc]e
psf | 3 | 0.95 | python foundation | python software foundation licen[sc]e(?: version 2)?
psf | 2 | 0.85 | psf | psf licen[sc]e
cnri | 2 | 0.9 | cnri python | cnri python licen[sc]e
php | 3 | 0.95 | php 3 | php licen[sc]e version 3(?: 01?)?
php | 2 | 0.9 | php | php licen[sc]e
ruby | 2 | 0.9 | ruby | ruby(?: s)? licen[sc]e
unlicense | 5 | 0.95 | unencumbered domain | this is free and unencumbered software released into the public domain
unlicense | 4 | 0.97 | unlicen* under | (?:licen[sc]ed|released) under (?:the )?unlicen[sc]e
unlicense | 2 | 0.9 | unlicen* | (?:the )?unlicen[sc]e
wtfpl | 2 | 0.9 | want public | do what the \S+ you want to public licen[sc]e
wtfpl | 2 | 0.85 | wtfpl* | wtfpl(?: ?v?2)?
beerware | 2 | 0.85 | beerware | (?:the )?beerware licen[sc]e
beerware | 2 | 0.85 | beer ware | (?:the )?beer ware licen[sc]e
cc0 | 5 | 0.95 | waived related rights | waived all copyright and related or neighboring rights
cc0 | 3 | 0.95 | cc0 universal | (?:creative commons )?cc0(?: 1 0)? universal
cc0 | 3 | 0.95 | publicdomain creativecommons | creativecommons org publicdomain zero 1 0
cc0 | 2 | 0.9 | cc0 | cc0(?: 1 0)?
cc0 | 2 | 0.85 | cc zero | cc zero(?: 1 0)?
cc0 | 2 | 0.85 | creative zero | creative commons zero
cc-by-nc-nd | 3 | 0.95 | cc nd | cc by nc nd(?: [1234] 0)?
cc-by-nc-nd | 3 | 0.95 | creativecommons nd licenses | creativecommons org licenses by nc nd(?: [1234] 0)?
cc-by-nc-nd | 3 | 0.9 | attribution no* | attribution non ?commercial no ?deriv(?:ative)?(?:s| works)?
cc-by-nc-sa | 3 | 0.95 | cc sa | cc by nc sa(?: [1234] 0)?
cc-by-nc-sa | 3 | 0.95 | creativecommons nc sa | creativecommons org licenses by nc sa(?: [1234] 0)?
cc-by-nc-sa | 3 | 0.9 | attribution share* | attribution non ?commercial share ?alike
cc-by-nc | 3 | 0.95 | cc nc | cc by nc(?: [1234] 0)?
cc-by-nc | 3 | 0.95 | creativecommons nc | creativecommons org licenses by nc(?: [1234] 0)?
cc-by-nc | 3 | 0.9 | attribution | attribution non ?commercial
cc-by-nd | 3 | 0.95 | cc nd by | cc by nd(?: [1234] 0)?
cc-by-nd | 3 | 0.95 | creativecommons nd | creativecommons org licenses by nd(?: [1234] 0)?
cc-by-nd | 3 | 0.9 | attribution no* | attribution no ?deriv(?:ative)?(?:s| works)?
cc-by-sa | 3 | 0.95 | cc sa by | cc by sa(?: [1234] 0)?
cc-by-sa | 3 | 0.95 | creativecommons sa | creativecommons org licenses by sa(?: [1234] 0)?
cc-by-sa | 3 | 0.9 | attribution share* | attribution share ?alike
cc-by | 3 | 0.95 | creativecommons licenses by | creativecommons org licenses by [1234] 0
cc-by | 2 | 0.9 | creative attribution | creative commons attribution(?: [1234] 0)?(?: international)?
cc-by | 2 | 0.9 | cc by | cc by(?: [1234] 0)?
creative-commons | 1 | 0.6 | creative commons | creative commons(?: licen[sc]e)?
ofl | 5 | 0.95 | font sil software | this font software is licensed under the sil open font licen[sc]e
ofl | 3 | 0.95 | font 1 | (?:sil )?open font licen[sc]e (?:version )?1 1
ofl | 2 | 0.9 | font open | (?:sil )?open font licen[sc]e
ofl | 2 | 0.85 | ofl | ofl 1 1
odbl | 2 | 0.95 | database open | open (?:data commons open )?database licen[sc]e
odbl | 2 | 0.85 | odbl* | odbl(?: ?v?1 0)?
odc-by | 2 | 0.95 | data commons attribution | open data commons attribution licen[sc]e
pddl | 2 | 0.95 | dedication domain | (?:open data commons )?public domain dedication and licen[sc]e
ogl | 2 | 0.9 | government open | open government licen[sc]e(?: v ?[123](?: 0)?)?
cdla | 3 | 0.95 | community data agreement | community data licen[sc]e agreement (?:permissive|sharing)
openrail | 4 | 0.97 | open* licen* | licen[sc]ed under (?:the )?(?:creativeml )?open ?rail(?: m)?
openrail | 3 | 0.95 | creativeml | creativeml open ?rail(?: m)?
openrail | 3 | 0.95 | bigscience rail | bigscience (?:bloom )?rail(?: 1 0)?(?: licen[sc]e)?
openrail | 2 | 0.85 | open* | open ?rail(?: m)?(?: licen[sc]e)?
openrail | 2 | 0.9 | responsible ai | responsible ai licen[sc]es?
llama | 4 | 0.95 | llama community | llama [234](?: [123])? community licen[sc]e(?: agreement)?
llama | 2 | 0.9 | llama licen* | llama (?:[234] )?licen[sc]e
gemma | 4 | 0.95 | gemma terms | gemma terms of use
nc-research | 4 | 0.9 | research non* | non ?commercial research (?:use )?(?:only )?licen[sc]e
nc-research | 4 | 0.9 | research purposes only | for (?:academic and )?research purposes only
nc-research | 3 | 0.85 | commercial use no* | (?:no|not for) commercial use
commons-clause | 4 | 0.95 | commons clause | commons clause(?: licen[sc]e condition)?
ms-pl | 2 | 0.95 | microsoft public | microsoft public licen[sc]e
ms-pl | 2 | 0.8 | ms pl | ms pl
ms-rl | 2 | 0.95 | microsoft reciprocal | microsoft reciprocal licen[sc]e
afl | 2 | 0.95 | academic | academic free licen[sc]e(?: (?:version |v ?)?[123] [01])?
osl | 2 | 0.95 | open software | open software licen[sc]e(?: (?:version |v ?)?[123] 0)?
ecl | 2 | 0.95 | educational | educational community licen[sc]e
ncsa | 2 | 0.95 | illinois | university of illinois(?: ncsa)? open source licen[sc]e
ncsa | 2 | 0.9 | ncsa | ncsa(?: open source)? licen[sc]e
postgresql | 2 | 0.95 | postgresql | postgresql licen[sc]e
openssl | 5 | 0.95 | openssl toolkit product* | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | 2 | 0.9 | openssl | openssl licen[sc]e
ssleay | 2 | 0.9 | ssleay | (?:original )?ssleay licen[sc]e
curl | 2 | 0.85 | curl | curl licen[sc]e
qpl | 2 | 0.9 | q public | q public licen[sc]e
sleepycat | 2 | 0.9 | sleepycat | sleepycat licen[sc]e
sspl | 2 | 0.95 | server side | server side public licen[sc]e(?: (?:version |v ?)1)?
sspl | 2 | 0.85 | sspl* | sspl(?: ?v?1)?
busl | 5 | 0.95 | business source additional | business source licen[sc]e (?:\S+ ){0,12}additional use grant
busl | 2 | 0.95 | business source | business source licen[sc]e(?: 1 1)?
elastic | 2 | 0.95 | elastic | elastic licen[sc]e(?: (?:version )?2 0)?
polyform | 2 | 0.95 | polyform | polyform (?:noncommercial|small business|shield|strict|perimeter|internal use) licen[sc]e
parity | 2 | 0.9 | parity | parity public licen[sc]e
prosperity | 2 | 0.9 | prosperity | prosperity public licen[sc]e
json | 5 | 0.95 | evil good | the software shall be used for good not evil
json | 2 | 0.9 | json | json licen[sc]e
vim | 2 | 0.9 | vim | vim licen[sc]e
w3c | 3 | 0.95 | w3c notice | w3c software (?:notice and licen[sc]e|and document notice and licen[sc]e)
w3c | 2 | 0.9 | w3c | w3c licen[sc]e
unicode | 2 | 0.9 | unicode terms | unicode terms of use
unicode | 2 | 0.9 | unicode licen* | unicode licen[sc]e(?: agreement)?
icu | 2 | 0.9 | icu | icu licen[sc]e
zpl | 2 | 0.95 | zope | zope public licen[sc]e(?: (?:version )?2 1)?
lppl | 5 | 0.95 | latex project distributed | may be distributed and or modified under the conditions of the latex project public licen[sc]e
lppl | 2 | 0.95 | latex project | latex project public licen[sc]e
cecill | 3 | 0.95 | cecill governed | governed by the cecill(?: [bc])? licen[sc]e
cecill | 2 | 0.9 | cecill* | cecill(?: [bc])?(?: licen[sc]e)?
mulan | 2 | 0.95 | mulan psl | mulan psl(?: v2)?
mulan | 2 | 0.95 | mulan permissive | mulan permissive software licen[sc]e
upl | 2 | 0.95 | universal permissive | universal permissive licen[sc]e
hpnd | 2 | 0.9 | historical permission | historical permission notice and disclaimer
imagemagick | 2 | 0.9 | imagemagick | imagemagick licen[sc]e
freetype | 2 | 0.9 | freetype | freetype (?:project )?licen[sc]e
jpeg | 5 | 0.9 | independent group jpeg | this software is based in part on the work of the independent jpeg group
tcl | 2 | 0.9 | tcl | tcl(?: tk)? licen[sc]e
intel | 2 | 0.9 | intel simplified | intel simplified software licen[sc]e
nvidia | 2 | 0.9 | nvidia | nvidia (?:open model |source code |software )?licen[sc]e(?: agreement)?
nasa | 2 | 0.9 | nasa | nasa open source agreement
rpl | 2 | 0.9 | reciprocal public | reciprocal public licen[sc]e
sissl | 2 | 0.9 | sun industry | sun industry standards source licen[sc]e
watcom | 2 | 0.9 | watcom | sybase open watcom public licen[sc]e
apsl | 2 | 0.9 | apple source | apple public source licen[sc]e
ngpl | 2 | 0.9 | nethack | nethack general public licen[sc]e
ofl | 2 | 0.85 | ubuntu font | ubuntu font licen[sc]e
bitstream | 2 | 0.85 | bitstream vera | bitstream vera (?:font )?licen[sc]e
public-domain | 4 | 0.9 | domain dedicated | dedicated to the public domain
public-domain | 4 | 0.9 | domain placed | placed in the public domain
public-domain | 4 | 0.9 | domain released | released into the public domain
public-domain | 4 | 0.85 | government work united | work of the united states government
public-domain | 2 | 0.5 | public domain | (?:is )?in the public domain
proprietary | 4 | 0.9 | proprietary confidential | proprietary and confidential
proprietary | 4 | 0.9 | unauthorized copying prohibited | unauthorized copying of this file (?:\S+ ){0,12}strictly prohibited
proprietary | 4 | 0.85 | trade secret* contains | contains (?:confidential )?(?:and )?trade secrets
proprietary | 4 | 0.85 | end user agreement | end user licen[sc]e agreement(?: eula)?
proprietary | 3 | 0.8 | written permission | may not be (?:reproduced|redistributed) (?:\S+ ){0,12}written permission
proprietary | 2 | 0.6 | reserved | all rights reserved
proprietary | 2 | 0.7 | internal use only | for internal use only
no-license | 2 | 0.6 | without licen* | without (?:a|any) licen[sc]e
dual-license | 3 | 0.8 | dual licen* | dual licen[sc]ed(?: under)?
copyright | 1 | 0.3 | copyright | copyright (?:c )?(?:[12][0-9]{3}|by)
copyright | 1 | 0.3 | copyleft | copyleft
some-license | 1 | 0.4 | licen* see | see (?:the )?licen[sc]e(?: file)? for (?:more )?(?:details|information)
some-license | 1 | 0.4 | licen* | (?:in the |the )?licen[sc]e (?:txt|md|file)
some-license | 1 | 0.4 | spdx identifier | spdx license identifier \S+
some-license | 1 | 0.4 | subject licen* | subject to the (?:terms of the )?(?:following )?licen[sc]e(?: terms)?
some-license | 1 | 0.4 | permissive* licen* | permissive(?:ly)? licen[sc]ed?
some-license | 1 | 0.4 | osi approved | osi approved(?: licen[sc]e)?
some-license | 1 | 0.4 | open source licen* | open source licen[sc]e
"""
