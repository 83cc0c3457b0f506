"""The signatures of ``licenses``, written by hand: notices, and names of licenses.

A line is label; gate; confidence; expression. Expressions are over lower-case words (letters, digits and what is not
ASCII) between single spaces; LIC is license or licence, and ``@2.0`` a version with or without the word, a v, or the
final zero. The gate holds words without which the expression cannot match: all of those between commas, one of those
between slashes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Texts of licenses and headers of files, in order: an earlier one goes before a later one.
NOTICES = r"""
mit-0; permission,hereby; 0.95; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
mit; permission,hereby; 0.95; permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?
mit; permission,hereby; 0.8; permission is hereby granted free of charge to any person obtaining
bsl-1.0; permission,hereby; 0.95; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
ofl-1.1; permission,hereby; 0.95; permission is hereby granted free of charge to any person obtaining a copy of the font software
unicode; permission,hereby; 0.9; permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
isc; permission,fee; 0.95; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
0bsd; permission,fee; 0.9; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd; permission,fee; 0.9; permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose (?:and without fee )?is hereby granted without fee
ntp; permission,fee; 0.9; permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
x11; consortium; 0.9; except as contained in this notice the name of the x consortium shall not be used in advertising
x11; advertising; 0.6; except as contained in this notice the names? of the above copyright holders? shall not be used in advertising
curl; notice,holder; 0.6; except as contained in this notice the name of a copyright holder shall not be used in advertising
bsd-4-clause; advertising,acknowledgement/acknowledgment; 0.95; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-3-clause; neither,endorse; 0.95; neither the names? of (?:\S+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products
bsd-3-clause; endorse; 0.85; the names? of the authors? may not be used to endorse or promote products derived from this software
bsd; redistribution,binary; 0.85; redistribution and use in source and binary forms with or without modification (?:is|are) permitted
bsd; redistributions; 0.75; redistributions of source code must retain the above copyright notice
bsd; redistributions; 0.75; redistributions in binary form must reproduce the above copyright notice
apache-1.1; apache,developed; 0.9; this product includes software developed by the apache (?:software foundation|group)
apache-2.0; compliance; 0.95; licensed under the apache LIC@2.0 the LIC you may not use this (?:file|work) except in compliance with the LIC
apache-2.0; apache,contributor; 0.9; licensed to the apache software foundation asf under one or more contributor LIC agreements
apache-2.0; apache,org; 0.9; www apache org licenses LIC 2 0
apache-2.0; contributor,perpetual; 0.85; each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright LIC
agpl-3.0; affero; 0.95; under the terms of the gnu affero general public LIC as published by the free software foundation either version 3 of the LIC
agpl-3.0; affero; 0.9; gnu affero general public LIC version 3 19 november 2007
agpl; affero; 0.85; under the terms of the (?:gnu )?affero general public LIC
lgpl-3.0; lesser; 0.95; under the terms of the gnu lesser general public LIC as published by the free software foundation either version 3 of the LIC
lgpl-3.0; lesser; 0.9; gnu lesser general public LIC version 3 29 june 2007
lgpl-2.1; lesser; 0.95; under the terms of the gnu lesser general public LIC as published by the free software foundation either version 2 1 of the LIC
lgpl-2.1; lesser; 0.9; gnu lesser general public LIC version 2 1 february 1999
lgpl-2.0; library; 0.95; under the terms of the gnu library general public LIC as published by the free software foundation either version 2 of the LIC
lgpl; lesser/library; 0.85; under the terms of the gnu (?:lesser|library) general public LIC
gpl-3.0; general,foundation; 0.95; under the terms of the gnu general public LIC as published by the free software foundation either version 3 of the LIC
gpl-3.0; general,3; 0.95; under the terms of the gnu general public LIC as published by the free software foundation version 3
gpl-3.0; general,june; 0.9; gnu general public LIC version 3 29 june 2007
gpl-2.0; general,foundation; 0.95; under the terms of the gnu general public LIC as published by the free software foundation either version 2 of the LIC
gpl-2.0; general,2; 0.95; under the terms of the gnu general public LIC(?: version 2)? as published by the free software foundation version 2
gpl-2.0; general,june; 0.9; gnu general public LIC version 2 june 1991
gpl-1.0; general,foundation; 0.95; under the terms of the gnu general public LIC as published by the free software foundation either version 1 or at your option any later version
gpl; general; 0.85; under the terms of the gnu general public LIC
gpl; redistribute; 0.8; this (?:program|software|file|library) is free software you can redistribute it and or modify it
gpl; general; 0.8; you should have received a copy of the gnu (?:affero |lesser |library )?general public LIC along with
gpl; warranty,merchantability; 0.6; without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu
gpl-3.0; copyleft; 0.8; the gnu general public LIC is a free copyleft LIC for software and other kinds of works
gfdl; documentation; 0.95; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation LIC
gfdl-1.3; documentation; 0.9; gnu free documentation LIC version 1 3
gfdl-1.2; documentation; 0.9; gnu free documentation LIC version 1 2
mpl-2.0; mozilla; 0.95; this source code form is subject to the terms of the mozilla public LIC@2.0
mpl-2.0; mpl; 0.85; if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0; incompatible,secondary; 0.85; this source code form is incompatible with secondary licenses
mpl-1.1; mozilla; 0.95; the contents of this file are subject to the mozilla public LIC@1.1
mpl-1.0; mozilla; 0.9; the contents of this file are subject to the mozilla public LIC@1.0
npl-1.1; netscape; 0.95; the contents of this file are subject to the netscape public LIC@1.1
epl-2.0; eclipse; 0.95; made available under the terms of the eclipse public LIC@2.0
epl-1.0; eclipse; 0.95; made available under the terms of the eclipse public LIC@1.0
epl-1.0; eclipse,program; 0.8; the accompanying program is provided under the terms of this eclipse public LIC
cpl-1.0; common; 0.9; made available under the terms of the common public LIC@1.0
ipl-1.0; ibm; 0.9; the accompanying program is provided under the terms of this ibm public LIC
cddl-1.0; common,development; 0.95; the contents of this file are subject to the terms of the common development and distribution LIC
cddl-1.1; common,development; 0.9; common development and distribution LIC@1.1
osl-3.0; open; 0.9; licensed under the open software LIC@3.0
afl-3.0; academic; 0.9; licensed under the academic free LIC@3.0
zlib; implied,liable; 0.95; this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib; altered; 0.85; altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng; png; 0.85; the png reference library is supplied as is
ijg; jpeg; 0.9; this software is based in part on the work of the independent jpeg group
info-zip; zip; 0.9; info zip is defined as the following set of individuals
openssl; openssl; 0.9; this product includes software developed by the openssl project for use in the openssl toolkit
ssleay; eric; 0.9; this product includes cryptographic software written by eric young
php-3.01; php; 0.9; this product includes php software freely available from
psf-2.0; psf; 0.9; psf hereby grants licensee a nonexclusive royalty free world wide LIC
cnri; cnri; 0.85; cnri hereby grants licensee a nonexclusive royalty free world wide LIC
ruby; bsdl; 0.85; you can redistribute it and or modify it under either the terms of the 2 clause bsdl
perl; perl; 0.9; you can redistribute it and or modify it under the same terms as perl(?: itself)?
artistic-1.0; package,intent; 0.8; the intent of this document is to state the conditions under which a package may be copied
artistic-2.0; package; 0.85; this LIC establishes the terms under which a given free software package may be copied modified distributed and or redistributed
boost; boost; 0.95; distributed under the boost software LIC@1.0
boost; boost; 0.85; accompanying file LIC 1 0 txt or copy at (?:https? )?www boost org
unlicense; unencumbered; 0.95; this is free and unencumbered software released into the public domain
unlicense; unlicense; 0.8; for more information please refer to (?:https? )?unlicense org
wtfpl; fuck; 0.95; you just do what the fuck you want to
wtfpl; fuck; 0.9; do what the fuck you want to public LIC
beerware; beer; 0.95; if we meet some day and you think this stuff is worth it you can buy me a beer in return
json; evil; 0.95; the software shall be used for good not evil
cc0-1.0; waived/dedicated; 0.95; to the extent possible under law (?:\S+ ){1,12}(?:has waived all copyright|has dedicated all copyright|have dedicated all copyright|have waived all copyright)
cc0-1.0; cc0; 0.9; cc0 1 0 universal
cc-by-nc-nd; creativecommons; 0.95; creativecommons org licenses by nc nd(?: [1-4] 0)?
cc-by-nc-sa; creativecommons; 0.95; creativecommons org licenses by nc sa(?: [1-4] 0)?
cc-by-nc; creativecommons; 0.95; creativecommons org licenses by nc(?: [1-4] 0)?
cc-by-nd; creativecommons; 0.95; creativecommons org licenses by nd(?: [1-4] 0)?
cc-by-sa; creativecommons; 0.95; creativecommons org licenses by sa(?: [1-4] 0)?
cc-by; creativecommons; 0.95; creativecommons org licenses by(?: [1-4] 0)?
cc0-1.0; creativecommons; 0.95; creativecommons org publicdomain zero(?: 1 0)?
cc-pdm; creativecommons; 0.9; creativecommons org publicdomain mark(?: 1 0)?
cc; rights,some; 0.6; some rights reserved
odbl-1.0; open,database; 0.9; made available under the open database LIC
odc-by-1.0; open,data; 0.9; made available under the open data commons attribution LIC
pddl-1.0; public,domain; 0.9; made available under the public domain dedication and LIC
ogl-3.0; open,government; 0.9; contains public sector information licensed under the open government LIC(?: v?3 0)?
etalab-2.0; ouverte; 0.85; licence ouverte(?: open licence)?(?: version)? 2 0
dl-de-by-2.0; datenlizenz; 0.9; datenlizenz deutschland namensnennung(?: version)? 2 0
dl-de-zero-2.0; datenlizenz; 0.9; datenlizenz deutschland zero(?: version)? 2 0
eupl-1.2; eupl; 0.95; licensed under the eupl(?: version)? 1 2(?: or later| or as soon they will be approved)?
eupl-1.1; eupl; 0.9; licensed under the eupl(?: version)? 1 1
cecill-2.1; cecill; 0.9; governed by the cecill LIC under french law
cecill-c; cecill; 0.9; governed by the cecill c LIC under french law
cecill-b; cecill; 0.9; governed by the cecill b LIC under french law
ms-pl; microsoft; 0.9; microsoft public LIC ms pl
ms-rl; microsoft; 0.9; microsoft reciprocal LIC ms rl
qpl-1.0; q; 0.85; the q public LIC version 1 0
lppl-1.3c; latex; 0.95; this work may be distributed and or modified under the conditions of the latex project public LIC
sleepycat; redistributions,db; 0.9; redistributions in any form must be accompanied by information on how to obtain complete source code for the db software
vim; vim; 0.85; there are no restrictions on distributing unmodified copies of vim
w3c; permission,royalty; 0.9; permission to copy modify and distribute this (?:work|software and its documentation) with or without modification for any purpose and without fee or royalty is hereby granted
zpl-2.1; zope; 0.9; zope public LIC zpl version 2 1
bitstream-vera; bitstream; 0.9; bitstream vera is a trademark of bitstream inc
ubuntu-font-1.0; ubuntu; 0.9; ubuntu font licence version 1 0
ofl-1.1; sil; 0.95; this font software is licensed under the sil open font LIC@1.1
sgi-b-2.0; sgi; 0.85; sgi free software LIC b version 2 0
nasa-1.3; nasa; 0.85; nasa open source agreement version 1 3
ncsa; illinois; 0.9; university of illinois ncsa open source LIC
llvm-exception; llvm; 0.9; apache LIC@2.0 with llvm exceptions?
classpath-exception; linking; 0.9; linking this library statically or dynamically with other modules is making a combined work based on this library
gcc-exception; gcc; 0.9; gcc runtime library exception(?: version 3 1)?
font-exception; font,embed; 0.85; if you create a document which uses this font and embed this font
commons-clause; grant,sell; 0.95; the grant of rights under the LIC will not include and the LIC does not grant to you the right to sell the software
busl-1.1; business; 0.95; business source LIC 1 1
busl-1.1; licensor,production; 0.85; the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
sspl-1.0; server; 0.95; server side public LIC(?: version 1)?
elastic-2.0; elastic; 0.95; elastic LIC 2 0
elastic-2.0; hosted,managed; 0.8; you may not provide the software to third parties as a hosted or managed service
polyform-nc; polyform; 0.9; polyform noncommercial LIC(?: 1 0 0)?
polyform-shield; polyform; 0.9; polyform shield LIC(?: 1 0 0)?
polyform-small; polyform; 0.9; polyform small business LIC(?: 1 0 0)?
openrail; rail/openrail; 0.9; (?:creativeml |bigscience |bigcode )?open ?rail(?: m| d| s)?(?: LIC)?(?: agreement)?
llama; llama; 0.9; llama [1-9](?: [1-9])? (?:community|version release date) ?(?:LIC agreement)?
fair-noncommercial; noncommercial,research; 0.8; for noncommercial research purposes only
anti-996; 996; 0.9; anti 996 LIC
hippocratic; hippocratic; 0.9; hippocratic LIC(?: version)?(?: [123] [0-9])?
blueoak-1.0.0; blue; 0.9; blue oak model LIC(?: 1 0 0)?
upl-1.0; universal; 0.9; the universal permissive LIC upl version 1 0
postgresql; postgresql; 0.9; postgresql database management system formerly known as postgres
mulan-2.0; mulan; 0.9; mulan (?:permissive software|psl) (?:LIC )?v2
"""

#: Notices that say what is not allowed, or who owns a text; they are weaker than those of licenses.
RESERVATIONS = r"""
proprietary; proprietary,confidential; 0.9; (?:proprietary and confidential|confidential and proprietary)(?: information)?
proprietary; trade; 0.8; (?:contains|constitutes) (?:the )?(?:confidential and )?(?:proprietary )?trade secrets of
proprietary; unauthorized; 0.85; unauthorized copying of this file via any medium is strictly prohibited
proprietary; unauthorized/unauthorised; 0.7; unauthori[sz]ed (?:use|copying|reproduction|distribution|duplication)(?: or (?:use|copying|reproduction|distribution|duplication))? is (?:strictly )?prohibited
proprietary; reproduced; 0.8; no part of this (?:publication|book|document|work|site) may be reproduced
proprietary; reproduced/redistributed; 0.7; may not be (?:published broadcast rewritten or redistributed|reproduced without (?:the )?(?:prior |express |written )*permission)
proprietary; prior/express,written; 0.7; without the (?:prior|express) written (?:permission|consent) of
proprietary; internal; 0.6; for internal use only
noncommercial; personal,commercial/noncommercial; 0.7; for personal (?:and )?non ?commercial use only
noncommercial; commercial/noncommercial; 0.7; for non ?commercial (?:use|purposes) only
noncommercial; commercial; 0.6; commercial use (?:of this \S+ )?is (?:strictly )?(?:prohibited|forbidden|not (?:allowed|permitted))
noncommercial; educational; 0.6; for educational (?:use|purposes) only
no-derivatives; derivative; 0.6; no derivative works (?:are )?(?:allowed|permitted)
no-training; train/training; 0.8; may not be used (?:for|to) train(?:ing)? (?:of )?(?:\S+ ){0,6}(?:models?|systems?|intelligence)
no-training; mining; 0.8; text and data mining (?:rights )?(?:is|are) (?:reserved|prohibited)
evaluation; evaluation; 0.6; for evaluation purposes only
warranty-disclaimer; warranty; 0.7; provided as is without warranty of any kind(?: express or implied)?
warranty-disclaimer; warranties; 0.6; without warranties or conditions of any kind(?: either express or implied)?
warranty-disclaimer; liable; 0.6; in no event shall the (?:authors?|copyright (?:owner|holder)s?)(?: or (?:authors?|copyright (?:owner|holder)s?|contributors))* be liable
patent-grant; patent; 0.6; hereby grants? (?:to )?you a (?:\S+ ){0,10}patent LIC
trademark; trademark/trademarks; 0.4; (?:is a|are) (?:registered )?trademarks? of
copyright; copyright; 0.6; copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?(?: by)?
copyright; copyright; 0.5; (?:c )?copyright by
copyright; c; 0.4; c (?:19|20)\d\d all rights
reserved; reserved; 0.6; all rights reserved(?: worldwide)?
reserved; droits; 0.6; tous droits (?:de reproduction )?réservés
reserved; rechte; 0.6; alle rechte vorbehalten
reserved; derechos; 0.6; todos los derechos reservados
see-license; see; 0.5; see (?:the )?(?:LIC|copying)(?: txt| md)? (?:file )?for (?:more |LIC |licensing )?(?:details|information|terms)
see-license; root; 0.6; found in the LIC file in the root directory of this source tree
"""

#: Names, in order: a more specific one before a less specific one.
NAMES = r"""
apache-2.0; apache; 0.5; apache(?: software)?(?: LIC)?@2.0
apache-1.1; apache; 0.5; apache(?: software)?(?: LIC)?@1.1
apache; apache; 0.4; apache(?: software)? LIC
mit-0; mit; 0.5; mit (?:0|no attribution)
mit; mit/expat; 0.4; (?:mit(?: x11)?|expat) LIC
bsd-2-clause; bsd/freebsd; 0.5; (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd LIC)
bsd-4-clause; bsd; 0.5; (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)
bsd-3-clause-clear; bsd; 0.5; bsd 3 clause clear
bsd-3-clause; bsd; 0.5; (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)
0bsd; 0bsd/zero; 0.5; (?:0bsd|bsd zero clause|zero clause bsd)
bsd; bsd; 0.4; bsd(?: style)? LIC
agpl-3.0; agpl/affero; 0.5; (?:gnu )?(?:agpl|affero general public LIC)@3.0
agpl; agpl/affero; 0.4; (?:gnu )?(?:agpl|affero general public LIC)
lgpl-2.1; lgpl/lesser; 0.5; (?:gnu )?(?:lgpl|lesser general public LIC)@2.1
lgpl-3.0; lgpl/lesser; 0.5; (?:gnu )?(?:lgpl|lesser general public LIC)@3.0
lgpl-2.0; lgpl/library; 0.5; (?:gnu )?(?:lgpl|library general public LIC)@2.0
lgpl; lgpl/lesser/library; 0.4; (?:gnu )?(?:lgpl|lesser general public LIC|library general public LIC)
gpl-2.0; gpl/general; 0.5; (?:gnu )?(?:gpl|general public LIC)(?: LIC)?@2.0
gpl-3.0; gpl/general; 0.5; (?:gnu )?(?:gpl|general public LIC)(?: LIC)?@3.0
gpl-1.0; gpl/general; 0.5; (?:gnu )?(?:gpl|general public LIC)(?: LIC)?@1.0
gpl; gpl/general; 0.4; (?:gnu )?(?:gpl|general public LIC)
gfdl; gfdl/documentation; 0.4; (?:gfdl|(?:gnu )?free documentation LIC)(?: 1 [123])?
mpl-2.0; mozilla/mpl; 0.5; (?:mozilla public LIC|mpl)@2.0
mpl-1.1; mozilla/mpl; 0.5; (?:mozilla public LIC|mpl)@1.1
mpl; mozilla; 0.4; mozilla public LIC
epl-2.0; eclipse/epl; 0.5; (?:eclipse public LIC|epl)@2.0
epl-1.0; eclipse/epl; 0.5; (?:eclipse public LIC|epl)@1.0
epl; eclipse; 0.4; eclipse public LIC
cddl-1.0; common/cddl; 0.5; (?:common development and distribution LIC|cddl)@1.0
cddl; common/cddl; 0.4; (?:common development and distribution LIC|cddl)
cpl-1.0; common; 0.4; common public LIC(?: 1 0)?
eupl-1.2; european/eupl; 0.5; (?:european union public LIC|eupl)@1.2
eupl; european/eupl; 0.4; (?:european union public LIC|eupl)
artistic-2.0; artistic; 0.5; (?:perl )?artistic(?: LIC)?@2.0
artistic; artistic; 0.4; (?:perl )?artistic LIC
isc; isc; 0.4; isc LIC
zlib; zlib; 0.4; zlib(?: libpng)? LIC
libpng; libpng; 0.4; libpng LIC
bsl-1.0; boost/bsl; 0.5; (?:boost software LIC|bsl)@1.0
bsl; boost; 0.4; boost(?: software)? LIC
psf-2.0; python/psf; 0.4; (?:python software foundation|psf) LIC(?:@2.0)?
php-3.01; php; 0.4; php LIC(?: 3 0 ?1)?
ruby; ruby; 0.4; ruby LIC
openssl; openssl; 0.4; openssl LIC
curl; curl; 0.4; curl LIC
unlicense; unlicense; 0.5; unlicense
wtfpl; wtfpl; 0.5; wtfpl
cc0-1.0; cc0/zero; 0.5; (?:cc0|cc zero|creative commons zero)@1.0
cc0-1.0; cc0/zero; 0.4; (?:cc0|cc zero|creative commons zero)
cc-by-nc-nd; cc/commons; 0.5; (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works))(?: [1-4] 0)?(?: international| unported)?
cc-by-nc-sa; cc/commons; 0.5; (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] 0)?(?: international| unported)?
cc-by-nc; cc/commons; 0.5; (?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] 0)?(?: international| unported)?
cc-by-nd; cc/commons; 0.5; (?:cc by nd|creative commons attribution no ?deriv(?:s|atives|ative works))(?: [1-4] 0)?(?: international| unported)?
cc-by-sa; cc/commons; 0.5; (?:cc by sa|creative commons attribution share ?alike)(?: [1-4] 0)?(?: international| unported)?
cc-by; cc/commons; 0.5; (?:cc by|creative commons attribution)(?: [1-4] 0)?(?: international| unported)?
ofl-1.1; font/ofl; 0.5; (?:sil )?(?:open font LIC|ofl)@1.1
ofl; font; 0.4; (?:sil )?open font LIC
odbl-1.0; database/odbl; 0.5; (?:open database LIC|odbl)(?: 1 0)?
ogl-3.0; government; 0.4; open government LIC(?: v?3 0)?
ms-pl; microsoft; 0.4; microsoft public LIC
lppl; latex/lppl; 0.4; (?:latex project public LIC|lppl)(?: 1 3c?)?
osl-3.0; osl/open; 0.4; (?:osl|open software LIC)@3.0
afl-3.0; afl/academic; 0.4; (?:afl|academic free LIC)@3.0
upl-1.0; upl; 0.4; upl 1 0
ncsa; ncsa; 0.4; ncsa(?: open source)? LIC
postgresql; postgresql; 0.4; postgresql LIC
busl-1.1; busl; 0.5; busl 1 1
sspl-1.0; sspl; 0.5; sspl(?: 1 0)?
cecill-2.1; cecill; 0.4; cecill 2 1
public-domain; domain; 0.4; (?:in|into|to) the public domain
"""

#: What stands before a name where the name is a grant.
GRANT = (
    "(?:licen[cs]ed|released|distributed|available|published|provided|offered|covered|dedicated|governed|placed|protected|redistributed|usable|shared)"
    "(?: to you| only| here| freely| solely)*(?: under| by| in| into| to| as| with)(?: the terms(?: and conditions)? of| the conditions of| terms of)?(?: the| a| an)?"
)
GRANT_WORDS = "licensed/licenced/released/distributed/available/published/provided/offered/covered/dedicated/governed/placed/protected/redistributed/usable/shared"


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    #: Of each of these sets a text must hold a word.
    gate: tuple[frozenset[str], ...]
    priority: int
    confidence: float


def _expression(text: str) -> str:
    def version(m: re.Match) -> str:
        major, minor = m.groups()
        return rf"(?:(?: version| v)? v?{major}{f' {minor}' if minor != '0' else '(?: 0)?'})"

    return re.sub(r"@(\d)\.(\d)", version, text).replace("LIC", "licen[cs]e")


def _lines(table: str) -> list[tuple[str, str, float, str]]:
    return [(label, gate, float(confidence), _expression(rx)) for label, gate, confidence, rx in (line.split("; ", 3) for line in table.strip().splitlines())]


def _gate(text: str) -> tuple[frozenset[str], ...]:
    return tuple(frozenset(one.split("/")) for one in text.split(","))


def rules() -> list[Rule]:
    """By priority: notices; identifiers after an SPDX tag; names as grants; names; reservations."""
    out, n = [], 1000
    for tag, table in (("notice", NOTICES), ("spdx", NAMES), ("grant", NAMES), ("name", NAMES), ("reservation", RESERVATIONS)):
        for label, gate, confidence, rx in _lines(table):
            n -= 1
            if tag == "spdx":
                out.append(Rule(label, f" spdx licen[cs]e identifier {_bare(rx)} ", (*_gate(gate), frozenset({"spdx"})), n, 1.0))
            elif tag == "grant":
                out.append(Rule(label, f" {GRANT} (?:{rx})(?: licen[cs]e)? ", (*_gate(gate), frozenset(GRANT_WORDS.split("/"))), n, confidence + 0.4))
            else:
                out.append(Rule(label, f" {rx} ", _gate(gate), n, confidence))
    return out


def _bare(rx: str) -> str:
    """A name without the word license at its end, as identifiers are."""
    return f"(?:{rx.removesuffix(' licen[cs]e')})"
