"""License scans: ordered signature rules behind a keyword prefilter.

A text becomes its lower-cased words joined by single spaces.  Every rule has a
keyword; only rules whose keyword the text holds run their regular expression.
Detections are ordered by the rules' priority, then by length; one whose interval
lies inside an accepted interval is suppressed, and so is one of a family that shares
words with a detection of a member (``gpl`` beside ``gpl-3``, ``cc-by`` beside
``cc-by-nc``).  Base phrases come first in priority, so nothing suppresses them.

The rules are signatures written by hand, from the most to the least specific: identifier
tags and addresses, sentences of licences and grants, titles with a version, titles
without one, abbreviations.  A title with a version has its own rule, so that it is never
taken for another version, and a title without one has a label without one.  A rule runs
on texts that hold one of its keywords; every match of the rule holds one, whichever
alternative it takes.

Defined results: a null or empty text has no words, no detection and a score of 0; very
long texts are scanned whole; of equal intervals of one priority the first rule's stays;
repeated rows are scanned one by one; an empty table gives no rows; further columns,
whatever their names, are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from functools import cache
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import ALNUM_TABLE, RESULT, annotate, raw_texts

#: The base phrases and their labels: fixed values.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)


class Rule(NamedTuple):
    priority: int
    place: int
    label: str
    keywords: tuple[bytes, ...]
    regex: str
    confidence: float


#: Identifiers as they stand in tags, and their labels.
TAGS = """
mit: mit; mit 0: mit-0; apache 1 1: apache-1.1; apache 2 0: apache-2; bsd 2 clause: bsd-2-clause; bsd 3 clause: bsd-3-clause; bsd 4 clause: bsd-4-clause; 0bsd: 0bsd
gpl 1 0 only: gpl-1; gpl 1 0 or later: gpl-1; gpl 1 0: gpl-1; gpl 2 0 only: gpl-2; gpl 2 0 or later: gpl-2; gpl 2 0: gpl-2; gpl 3 0 only: gpl-3; gpl 3 0 or later: gpl-3; gpl 3 0: gpl-3
lgpl 2 0 only: lgpl-2; lgpl 2 0 or later: lgpl-2; lgpl 2 0: lgpl-2; lgpl 2 1 only: lgpl-2.1; lgpl 2 1 or later: lgpl-2.1; lgpl 2 1: lgpl-2.1; lgpl 3 0 only: lgpl-3; lgpl 3 0 or later: lgpl-3; lgpl 3 0: lgpl-3
agpl 3 0 only: agpl-3; agpl 3 0 or later: agpl-3; agpl 3 0: agpl-3; mpl 1 0: mpl-1; mpl 1 1: mpl-1.1; mpl 2 0: mpl-2; epl 1 0: epl-1; epl 2 0: epl-2; cddl 1 0: cddl-1; cddl 1 1: cddl-1.1; cpl 1 0: cpl-1
isc: isc; zlib: zlib; bsl 1 0: boost-1; busl 1 1: busl-1.1; artistic 1 0: artistic-1; artistic 2 0: artistic-2; unlicense: unlicense; wtfpl: wtfpl; eupl 1 1: eupl-1.1; eupl 1 2: eupl-1.2; postgresql: postgresql
psf 2 0: python-2; python 2 0: python-2; ruby: ruby; openssl: openssl; ofl 1 1: ofl-1.1; odbl 1 0: odbl-1; odc by 1 0: odc-by-1; pddl 1 0: pddl-1; cc0 1 0: cc0-1; sspl 1 0: sspl-1; ms pl: ms-pl; ms rl: ms-rl; ncsa: ncsa; vim: vim
cc by 2 0: cc-by; cc by 3 0: cc-by; cc by 4 0: cc-by; cc by sa 3 0: cc-by-sa; cc by sa 4 0: cc-by-sa; cc by nd 4 0: cc-by-nd; cc by nc 4 0: cc-by-nc; cc by nc sa 4 0: cc-by-nc-sa; cc by nc nd 4 0: cc-by-nc-nd; gfdl 1 2: gfdl-1.2; gfdl 1 3: gfdl-1.3
"""
#: Signatures: label; keywords divided by |; expression over words; confidence.
ADDRESSES = r"""
apache-2; apache org; (?:www )?apache org licenses license 2 0; 0.95
apache-1.1; apache org; (?:www )?apache org licenses license 1 1; 0.95
gpl-2; gnu org; (?:www )?gnu org licenses (?:old licenses )?gpl 2 0; 0.95
gpl-3; gnu org; (?:www )?gnu org licenses gpl 3 0; 0.95
gpl; gnu org; (?:www )?gnu org licenses gpl(?: html)?; 0.9
lgpl-2.1; gnu org; (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1; 0.95
lgpl-3; gnu org; (?:www )?gnu org licenses lgpl 3 0; 0.95
lgpl; gnu org; (?:www )?gnu org licenses lgpl(?: html)?; 0.9
agpl-3; gnu org; (?:www )?gnu org licenses agpl 3 0; 0.95
agpl; gnu org; (?:www )?gnu org licenses agpl(?: html)?; 0.9
gfdl; gnu org; (?:www )?gnu org (?:licenses|copyleft) fdl(?: html)?; 0.9
mpl-2; mozilla org; (?:www )?mozilla org mpl 2 0; 0.95
mpl-1.1; mozilla org; (?:www )?mozilla org mpl mpl 1 1; 0.95
mpl; mozilla org; (?:www )?mozilla org mpl; 0.85
epl-1; eclipse org; (?:www )?eclipse org legal epl v10; 0.95
epl-2; eclipse org; (?:www )?eclipse org legal epl (?:v20|2 0); 0.95
boost-1; boost org; (?:www )?boost org license 1 0; 0.95
unlicense; unlicense org; unlicense org; 0.95
wtfpl; wtfpl net; (?:www )?wtfpl net; 0.95
ofl-1.1; sil org|openfontlicense org; (?:scripts sil org ofl|openfontlicense org); 0.9
odbl-1; opendatacommons org; opendatacommons org licenses odbl(?: 1 0)?; 0.95
odc-by-1; opendatacommons org; opendatacommons org licenses by(?: 1 0)?; 0.95
pddl-1; opendatacommons org; opendatacommons org licenses pddl(?: 1 0)?; 0.95
cc-by; creativecommons org; creativecommons org licenses by [1-4] [05]; 0.95
cc-by-sa; creativecommons org; creativecommons org licenses by sa [1-4] [05]; 0.95
cc-by-nd; creativecommons org; creativecommons org licenses by nd [1-4] [05]; 0.95
cc-by-nc; creativecommons org; creativecommons org licenses by nc [1-4] [05]; 0.95
cc-by-nc-sa; creativecommons org; creativecommons org licenses by nc sa [1-4] [05]; 0.95
cc-by-nc-nd; creativecommons org; creativecommons org licenses by nc nd [1-4] [05]; 0.95
cc0-1; creativecommons org; creativecommons org publicdomain zero 1 0; 0.95
public-domain; creativecommons org; creativecommons org publicdomain mark 1 0; 0.9
"""
SENTENCES = r"""
mit; hereby granted free of charge; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files; 0.95
mit; hereby granted free of charge; permission is hereby granted free of charge to any person obtaining a copy; 0.9
mit; permission notice shall be included; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software; 0.9
isc; for any purpose with or without fee; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that; 0.9
0bsd; for any purpose with or without fee; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided; 0.9
bsd; redistribution and use; redistribution and use in source and binary forms with or without modification are permitted provided that; 0.9
bsd-2-clause; this software is provided by; redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by; 0.9
bsd-3-clause; endorse or promote products derived; (?:may be )?used to endorse or promote products derived from this software without specific prior written permission; 0.85
bsd-4-clause; all advertising materials; all advertising materials mentioning features or use of this software must display; 0.95
apache-2; licensed under the apache license; licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license; 0.95
apache-2; perpetual worldwide non exclusive; each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license; 0.9
apache-1.1; this product includes software developed by the apache; this product includes software developed by the apache software foundation; 0.8
gpl-2; either version 2 of the license; (?:general public license as published by the free software foundation )?either version 2 of the license or at your option any later version; 0.85
gpl-3; either version 3 of the license; (?:general public license as published by the free software foundation )?either version 3 of the license or at your option any later version; 0.85
lgpl-2.1; either version 2 1 of the license; (?:lesser general public license as published by the free software foundation )?either version 2 1 of the license or at your option any later version; 0.9
gpl; redistribute it and or modify it under the terms of the gnu general; free software you can redistribute it and or modify it under the terms of the gnu general public license; 0.95
lgpl; redistribute it and or modify it under the terms of the gnu lesser; free software you can redistribute it and or modify it under the terms of the gnu lesser general public license; 0.95
agpl; redistribute it and or modify it under the terms of the gnu affero; free software you can redistribute it and or modify it under the terms of the gnu affero general public license; 0.95
gpl; copy of the gnu general public license; you should have received a copy of the gnu general public license along with this program; 0.9
lgpl; copy of the gnu lesser general public license; you should have received a copy of the gnu lesser general public license; 0.9
agpl; copy of the gnu affero general public license; you should have received a copy of the gnu affero general public license; 0.9
gfdl; gnu free documentation license; permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license; 0.95
mpl-2; subject to the terms of the mozilla; this source code form is subject to the terms of the mozilla public license v 2 0; 0.95
mpl-1.1; contents of this file are subject to the mozilla; the contents of this file are subject to the mozilla public license version 1 1; 0.95
mpl-2; copy of the mpl was not distributed; if a copy of the mpl was not distributed with this file you can obtain one at; 0.95
epl-1; accompanying materials are made available; this program and the accompanying materials are made available under the terms of the eclipse public license v1 0; 0.95
epl-2; accompanying materials are made available; this program and the accompanying materials are made available under the terms of the eclipse public license 2 0; 0.95
cddl; common development and distribution license; the contents of this file are subject to the terms of the common development and distribution license; 0.95
boost-1; boost software license; distributed under the boost software license version 1 0; 0.95
zlib; as is without any express or implied warranty; this software is provided as is without any express or implied warranty in no event will the authors be held liable; 0.9
zlib; altered source versions must be plainly marked; altered source versions must be plainly marked as such and must not be misrepresented as being the original software; 0.9
unlicense; free and unencumbered; this is free and unencumbered software released into the public domain; 0.95
wtfpl; do what the fuck you want; do what the fuck you want to(?: public license)?; 0.95
artistic-2; artistic license 2 0; everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed the artistic license 2 0; 0.9
python-2; python software foundation; (?:this license agreement is between the )?python software foundation psf and the individual or organization; 0.9
openssl; openssl project; this product includes software developed by the openssl project for use in the openssl toolkit; 0.95
ofl-1.1; this font software is licensed; this font software is licensed under the sil open font license version 1 1; 0.95
ms-pl; microsoft public license; (?:this license governs use of the accompanying software )?microsoft public license ms pl; 0.9
ncsa; illinois; university of illinois ncsa open source license; 0.95
json; used for good not evil; the software shall be used for good not evil; 0.95
beerware; buy me a beer; you can buy me a beer in return; 0.95
vim; vim; vim is charityware; 0.9
odbl-1; open database; this (?:data|database) is made available under the open database license; 0.95
cc-by; creative commons attribution; licensed under a creative commons attribution [1-4] [05](?: international| unported)? license; 0.95
cc-by-sa; creative commons attribution; licensed under a creative commons attribution share ?alike [1-4] [05](?: international| unported)? license; 0.95
cc-by-nc; creative commons attribution; licensed under a creative commons attribution non ?commercial [1-4] [05](?: international| unported)? license; 0.95
cc-by-nc-sa; creative commons attribution; licensed under a creative commons attribution non ?commercial share ?alike [1-4] [05](?: international| unported)? license; 0.95
cc-by-nc-nd; creative commons attribution; licensed under a creative commons attribution non ?commercial no ?deriv(?:ative)?s [1-4] [05](?: international| unported)? license; 0.95
cc-by-nd; creative commons attribution; licensed under a creative commons attribution no ?deriv(?:ative)?s [1-4] [05](?: international| unported)? license; 0.95
cc0-1; waived all copyright; (?:has )?waived all copyright and related or neighboring rights; 0.95
public-domain; the public domain; (?:released|placed|dedicated) (?:in|into|to) the public domain; 0.8
public-domain; public domain; (?:this work|this file|this software|it) is in the public domain; 0.8
proprietary; proprietary and confidential; (?:is |are )?proprietary and confidential; 0.7
proprietary; unauthorized copying; unauthorized copying of this (?:file|software|document) (?:via any medium )?is strictly prohibited; 0.8
proprietary; all rights reserved; (?:copyright )?all rights reserved; 0.5
proprietary; may not be reproduced; may not be reproduced (?:distributed )?or transmitted in any form; 0.7
"""
VERSIONED = r"""
apache-1; apache; apache(?: software)? license(?: version)? 1 0; 0.85
apache-1.1; apache; apache(?: software)? license(?: version)? 1 1; 0.85
apache-2; apache; apache(?: software)? license(?: version)? (?:2 0|2|v2 0|v2); 0.85
gpl-1; general public license; (?:gnu )?general public license (?:version |v )?(?:1 0|1|v1); 0.85
gpl-2; general public license; (?:gnu )?general public license (?:version |v )?(?:2 0|2|v2 0|v2); 0.85
gpl-3; general public license; (?:gnu )?general public license (?:version |v )?(?:3 0|3|v3 0|v3); 0.85
lgpl-2; library general public; (?:gnu )?library general public license(?: version)? (?:2 0|2|v2); 0.85
lgpl-2.1; lesser general public; (?:gnu )?lesser general public license (?:version |v )?(?:2 1|v2 1); 0.85
lgpl-3; lesser general public; (?:gnu )?lesser general public license (?:version |v )?(?:3 0|3|v3 0|v3); 0.85
agpl-1; affero general public; (?:gnu )?affero general public license (?:version |v )?(?:1 0|1|v1); 0.85
agpl-3; affero general public; (?:gnu )?affero general public license (?:version |v )?(?:3 0|3|v3 0|v3); 0.85
gfdl-1.2; free documentation; (?:gnu )?free documentation license (?:version )?1 2; 0.85
gfdl-1.3; free documentation; (?:gnu )?free documentation license (?:version )?1 3; 0.85
mpl-1; mozilla public; mozilla public license (?:version |v )?(?:1 0|v1 0); 0.85
mpl-1.1; mozilla public; mozilla public license (?:version |v )?(?:1 1|v1 1); 0.85
mpl-2; mozilla public; mozilla public license (?:version |v )?(?:2 0|2|v2 0|v2); 0.85
epl-1; eclipse public; eclipse public license (?:version |v )?(?:1 0|1|v1 0|v10); 0.85
epl-2; eclipse public; eclipse public license (?:version |v )?(?:2 0|2|v2 0|v20); 0.85
cddl-1; common development and distribution; common development and distribution license(?: cddl)? (?:version |v )?(?:1 0|v1 0); 0.85
cddl-1.1; common development and distribution; common development and distribution license(?: cddl)? (?:version |v )?(?:1 1|v1 1); 0.85
cpl-1; common public license; common public license (?:version |v )?(?:1 0|1|v1 0); 0.85
boost-1; boost software; boost software license (?:version )?1 0; 0.85
busl-1.1; business source; business source license (?:version )?1 1; 0.85
artistic-1; artistic license; (?:the )?artistic license (?:version )?(?:1 0|1); 0.85
artistic-2; artistic license; (?:the )?artistic license (?:version )?(?:2 0|2); 0.85
eupl-1.1; european union public; european union public licen[cs]e (?:version |v )?(?:1 1|v1 1); 0.85
eupl-1.2; european union public; european union public licen[cs]e (?:version |v )?(?:1 2|v1 2); 0.85
python-2; python software foundation; python software foundation license (?:version )?2; 0.85
ofl-1.1; open font; (?:sil )?open font license (?:version )?1 1; 0.85
ofl-1; open font; (?:sil )?open font license (?:version )?1 0; 0.85
sspl-1; server side public; server side public license (?:version )?1; 0.85
osl-3; open software license; open software license (?:version )?3 0; 0.85
afl-3; academic free; academic free license (?:version )?3 0; 0.85
cc-by; creative commons attribution; creative commons attribution [1-4] [05](?: international| unported)?; 0.85
cc-by-sa; creative commons attribution; creative commons attribution share ?alike [1-4] [05](?: international| unported)?; 0.85
cc-by-nd; creative commons attribution; creative commons attribution no ?deriv(?:ative)?s [1-4] [05](?: international| unported)?; 0.85
cc-by-nc; creative commons attribution; creative commons attribution non ?commercial [1-4] [05](?: international| unported)?; 0.85
cc-by-nc-sa; creative commons attribution; creative commons attribution non ?commercial share ?alike [1-4] [05](?: international| unported)?; 0.85
cc-by-nc-nd; creative commons attribution; creative commons attribution non ?commercial no ?deriv(?:ative)?s [1-4] [05](?: international| unported)?; 0.85
cc0-1; cc0; cc0 1 0(?: universal)?; 0.85
gpl-1; gpl; (?:gnu )?gpl ?(?:v|version )?1(?: 0)?; 0.75
gpl-2; gpl; (?:gnu )?gpl (?:v |version )?(?:2 0|2|v2 0|v2); 0.75
gpl-2; gplv2; gplv2(?: 0)?; 0.75
gpl-3; gpl; (?:gnu )?gpl (?:v |version )?(?:3 0|3|v3 0|v3); 0.75
gpl-3; gplv3; gplv3(?: 0)?; 0.75
lgpl-2; lgpl; lgpl (?:v |version )?(?:2 0|2|v2 0|v2); 0.75
lgpl-2.1; lgpl; lgpl (?:v |version )?(?:2 1|v2 1); 0.75
lgpl-2.1; lgplv2 1; lgplv2 1; 0.75
lgpl-3; lgpl; lgpl (?:v |version )?(?:3 0|3|v3 0|v3); 0.75
lgpl-3; lgplv3; lgplv3(?: 0)?; 0.75
agpl-3; agpl; agpl (?:v |version )?(?:3 0|3|v3 0|v3); 0.75
agpl-3; agplv3; agplv3(?: 0)?; 0.75
mpl-1.1; mpl; mpl (?:v |version )?(?:1 1|v1 1); 0.75
mpl-2; mpl; mpl (?:v |version )?(?:2 0|v2 0); 0.75
epl-1; epl; epl (?:v |version )?(?:1 0|v1 0); 0.75
epl-2; epl; epl (?:v |version )?(?:2 0|v2 0); 0.75
apache-2; apache 2 0; apache 2 0; 0.75
apache-2; apache v2|apache2; (?:apache v2(?: 0)?|apache2(?: 0)?) licen[cs]e; 0.75
eupl-1.1; eupl; eupl (?:v |version )?(?:1 1|v1 1); 0.75
eupl-1.2; eupl; eupl (?:v |version )?(?:1 2|v1 2); 0.75
cddl-1; cddl; cddl (?:v |version )?(?:1 0|v1 0); 0.75
cddl-1.1; cddl; cddl (?:v |version )?(?:1 1|v1 1); 0.75
cc0-1; creative commons zero; creative commons zero(?: (?:v1 0|1 0))?(?: universal)?(?: licen[cs]e)?; 0.85
cc-by; cc by; cc by [1-4] [05]; 0.8
cc-by-sa; cc by sa; cc by sa [1-4] [05]; 0.8
cc-by-nd; cc by nd; cc by nd [1-4] [05]; 0.8
cc-by-nc; cc by nc; cc by nc [1-4] [05]; 0.8
cc-by-nc-sa; cc by nc sa; cc by nc sa [1-4] [05]; 0.8
cc-by-nc-nd; cc by nc nd; cc by nc nd [1-4] [05]; 0.8
"""
TITLES = r"""
mit; mit|expat; (?:the )?(?:mit expat|mit x11|mit|expat) licen[cs]e; 0.8
mit; mit|expat; licen[cs]e (?:is |type |name )?(?:mit|expat); 0.7
mit; under mit|under the mit|under expat|under the expat; (?:licensed|released|distributed|available|published) under (?:the )?(?:mit|expat); 0.7
mit; terms of the mit|terms of the expat; under the terms of the (?:mit|expat)(?: license)?; 0.8
mit-0; mit no attribution; mit no attribution(?: license)?; 0.85
apache; apache; (?:the )?apache(?: software)? licen[cs]e; 0.7
apache; apache; licen[cs]e (?:is |type |name )?apache; 0.6
bsd-2-clause; 2 clause; (?:bsd 2 clause|2 clause bsd)(?: license)?; 0.85
bsd-2-clause; simplified bsd|freebsd; (?:simplified bsd|freebsd) license; 0.85
bsd-3-clause; 3 clause; (?:bsd 3 clause|3 clause bsd)(?: license)?; 0.85
bsd-3-clause; new bsd|revised bsd|modified bsd; (?:new|revised|modified) bsd license; 0.85
bsd-4-clause; 4 clause; (?:bsd 4 clause|4 clause bsd)(?: license)?; 0.85
bsd-4-clause; original bsd; original bsd license; 0.85
0bsd; zero clause; (?:zero clause bsd|bsd zero clause)(?: license)?; 0.85
0bsd; 0bsd; 0bsd(?: license)?; 0.8
bsd; bsd; (?:the )?bsd(?: style)? licen[cs]e; 0.7
bsd; bsd; licen[cs]e (?:is |type |name )?bsd; 0.6
gpl; general public; (?:the )?(?:gnu )?general public licen[cs]e; 0.75
gpl; gpl; (?:the )?(?:gnu )?gpl licen[cs]e; 0.7
gpl; gpl; (?:licen[cs]e (?:is |type |name )?|under (?:the )?)(?:gnu )?gpl; 0.65
lgpl; lesser general; (?:the )?(?:gnu )?lesser general public licen[cs]e; 0.75
lgpl; library general; (?:the )?(?:gnu )?library general public licen[cs]e; 0.75
lgpl; lgpl; (?:the )?(?:gnu )?lgpl licen[cs]e; 0.7
lgpl; lgpl; (?:licen[cs]e (?:is |type |name )?|under (?:the )?)(?:gnu )?lgpl; 0.65
agpl; affero; (?:the )?(?:gnu )?affero general public licen[cs]e; 0.75
agpl; agpl; (?:the )?(?:gnu )?agpl licen[cs]e; 0.7
agpl; agpl; (?:licen[cs]e (?:is |type |name )?|under (?:the )?)(?:gnu )?agpl; 0.65
gfdl; free documentation; (?:gnu )?free documentation license; 0.75
gfdl; gfdl; (?:gnu )?gfdl; 0.7
mpl; mozilla public; mozilla public licen[cs]e; 0.75
mpl; mpl; (?:the )?mpl licen[cs]e; 0.65
epl; eclipse public; eclipse public licen[cs]e; 0.75
edl; eclipse distribution; eclipse distribution licen[cs]e; 0.75
cddl; common development and distribution; common development and distribution licen[cs]e; 0.75
cddl; cddl; (?:the )?cddl(?: license)?; 0.65
cpl; common public license; common public license; 0.7
isc; isc; (?:the )?isc licen[cs]e; 0.8
isc; isc; licen[cs]e (?:is |type |name )?isc; 0.7
isc; isc; (?:under (?:the )?|spdx )isc; 0.65
zlib; zlib; (?:the )?zlib(?: libpng)? licen[cs]e; 0.8
boost; boost software; boost software licen[cs]e; 0.75
busl; business source; business source licen[cs]e; 0.75
artistic; artistic; (?:the )?artistic licen[cs]e; 0.75
artistic-2; clarified artistic; clarified artistic license; 0.7
unlicense; unlicense; (?:the )?unlicense(?: license)?; 0.75
wtfpl; wtfpl; (?:the )?wtfpl(?: license)?; 0.8
eupl; european union public; european union public licen[cs]e; 0.75
postgresql; postgresql; (?:the )?postgresql licen[cs]e; 0.8
python; python; (?:the )?python(?: software foundation)? licen[cs]e; 0.7
python; psf; (?:the )?psf licen[cs]e; 0.7
ruby; ruby; (?:the )?ruby licen[cs]e; 0.75
php; php; (?:the )?php licen[cs]e; 0.75
perl; perl; same terms as perl(?: itself)?; 0.75
openssl; openssl; (?:the )?openssl licen[cs]e; 0.75
ofl; open font; (?:sil )?open font licen[cs]e; 0.75
odbl-1; open database; open database licen[cs]e; 0.75
odc-by-1; open data commons; open data commons attribution licen[cs]e; 0.8
pddl-1; public domain dedication; public domain dedication and licen[cs]e; 0.8
sspl; server side public; server side public licen[cs]e; 0.75
ms-pl; microsoft public; microsoft public licen[cs]e; 0.75
ms-rl; microsoft reciprocal; microsoft reciprocal licen[cs]e; 0.75
ncsa; ncsa; (?:the )?ncsa(?: open source)? licen[cs]e; 0.75
osl; open software license; open software license; 0.65
afl; academic free; academic free licen[cs]e; 0.75
ibm; ibm public; ibm public licen[cs]e; 0.75
sun; sun public; sun public licen[cs]e; 0.75
apple; apple public source; apple public source licen[cs]e; 0.75
nokia; nokia open source; nokia open source licen[cs]e; 0.75
cecill; cecill; (?:the )?cecill(?: license)?; 0.75
mulan; mulan; mulan (?:psl|permissive software license)(?: v2)?; 0.8
elastic; elastic license; (?:the )?elastic license(?: 2 0)?; 0.75
commons-clause; commons clause; commons clause(?: license condition)?; 0.75
polyform; polyform; polyform (?:noncommercial|small business|shield|strict)(?: license)?; 0.8
openrail; openrail; (?:creativeml |bigscience )?openrail(?: m)?(?: license)?; 0.75
llama; llama; llama (?:2 |3 )?community license(?: agreement)?; 0.8
cc0-1; cc0|cc zero; (?:cc0|cc zero)(?: universal)?(?: license)?; 0.75
cc-by-sa; creative commons attribution; creative commons attribution share ?alike(?: license)?; 0.75
cc-by-nd; creative commons attribution; creative commons attribution no ?deriv(?:ative)?s(?: license)?; 0.75
cc-by-nc; creative commons attribution; creative commons attribution non ?commercial(?: license)?; 0.75
cc-by-nc-sa; creative commons attribution; creative commons attribution non ?commercial share ?alike(?: license)?; 0.75
cc-by-nc-nd; creative commons attribution; creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: license)?; 0.75
cc-by; creative commons attribution; creative commons attribution(?: license)?; 0.7
cc; creative commons; creative commons licen[cs]e; 0.6
cc-by-nc-sa; cc by nc sa; cc by nc sa; 0.75
cc-by-nc-nd; cc by nc nd; cc by nc nd; 0.75
cc-by-sa; cc by sa; cc by sa; 0.75
cc-by-nd; cc by nd; cc by nd; 0.75
cc-by; licensed cc by|license cc by|under cc by|a cc by|the cc by; (?:licensed|license|under|a|the) cc by(?: license)?; 0.6
"""


@cache
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority; those of the base phrases have priority 0."""
    words = lambda keywords: tuple(keywords.encode().split(b"|"))
    out = [Rule(0, i, label, words(phrase), phrase, 1.0) for i, (phrase, label) in enumerate(BASE)]
    places = "spdx license identifier|opensource org licenses|opensource org license|choosealicense com licenses|spdx org licenses"
    for tag in TAGS.replace("\n", ";").split(";"):
        if tag.strip():
            text, label = map(str.strip, tag.split(":"))
            out.append(Rule(1, len(out), label, words(places), rf"(?:{places}) {text}", 1.0))
    for priority, lines in enumerate((ADDRESSES, SENTENCES, VERSIONED, TITLES), 2):
        for line in lines.strip().splitlines():
            label, keywords, regex, confidence = line.split("; ")
            out.append(Rule(priority, len(out), label, words(keywords), regex, float(confidence)))
    return tuple(sorted(out))


def normalised(text: bytes) -> bytes:
    """The words, a space before and after each."""
    words = text.translate(ALNUM_TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b" "


class Scanner:
    """The rules, compiled on first use and grouped by keyword."""

    def __init__(self):
        self.by_keyword: dict[bytes, list[int]] = {}
        self.rules = rules()
        self.compiled: dict[int, re.Pattern] = {}
        for i, r in enumerate(self.rules):
            for k in r.keywords:
                self.by_keyword.setdefault(k, []).append(i)

    def detect(self, norm: bytes) -> list[tuple[int, int, int]]:
        """Accepted detections: rule, first byte and end in the normalised text."""
        found = []
        for i in sorted({i for k, of in self.by_keyword.items() if k in norm for i in of}):
            if i not in self.compiled:
                self.compiled[i] = re.compile(rb"(?<= )(?:" + self.rules[i].regex.encode() + rb")(?= )")
            found += [(i, m.start(), m.end()) for m in self.compiled[i].finditer(norm)]
        return specific(suppressed(found, self.rules), self.rules)


def specific(found: list[tuple[int, int, int]], of: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """Without the detections of a family (``cc-by``) that share a word with one of its members (``cc-by-nc``), base phrases excepted."""
    ends: dict[str, tuple[list[int], list[int]]] = {}
    for i, a, b in sorted(found, key=lambda x: x[1]):
        label = of[i].label
        for k in range(len(label)):
            if label[k] == "-":
                starts, last = ends.setdefault(label[:k], ([], []))
                starts.append(a)
                last.append(max(b, last[-1] if last else b))
    out = []
    for i, a, b in found:
        starts, last = ends.get(of[i].label, ((), ()))
        # of the members that begin before its end, the furthest end
        k = bisect_left(starts, b)
        if not of[i].priority or not k or last[k - 1] <= a:
            out.append((i, a, b))
    return out


def suppressed(found: list[tuple[int, int, int]], of: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """Without the detections that lie inside one of higher priority, or of the same and longer."""
    kept: list[tuple[int, int, int]] = []
    widest: list[tuple[int, int]] = []  # accepted intervals that lie in no other, in order
    for i, a, b in sorted(found, key=lambda x: (of[x[0]].priority, x[1] - x[2], x[1], x[0])):
        at = bisect_right(widest, (a, float("inf"))) - 1
        # ends rise with starts in widest, so only the last that starts at or before a can hold it
        if of[i].priority and at >= 0 and widest[at][1] >= b:
            continue
        kept.append((i, a, b))
        if at >= 0 and widest[at][1] >= b:
            continue
        j = bisect_right(widest, (a, -1))
        while j < len(widest) and widest[j][1] <= b:
            widest.pop(j)
        insort(widest, (a, b))
    return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


_FIELDS = "n_words long, detections array<struct<label:string,priority:int,first_word:long,n_words:long,confidence:double>>"


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and RESULT: n_words and the accepted detections, priority 0 for base phrases."""

    def start():
        scanner = Scanner()

        def work(column):
            out: dict[str, list] = {"n_words": [], "detections": []}
            for x in raw_texts(column):
                norm = normalised(x)
                out["n_words"].append(norm.count(b" ") - 1)
                rows, seen, at = [], 0, 0
                for i, a, b in scanner.detect(norm):
                    seen, at = seen + norm.count(b" ", at, a), a
                    r = scanner.rules[i]
                    rows.append({"label": r.label, "priority": r.priority, "first_word": seen - 1, "n_words": norm.count(b" ", a, b) + 1, "confidence": r.confidence})
                out["detections"].append(rows)
            return out

        return work

    return annotate(docs, start, _FIELDS, [text], keep)


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row a document: words, base places, labels, and the highest confidence as score."""
    found = scan(docs, ["doc_id"], text)
    every = F.col(f"{RESULT}.detections")
    base = F.filter(every, lambda d: d["priority"] == 0)
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda d: d["label"]))), ",")
    return found.select(
        "doc_id",
        F.col(f"{RESULT}.n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(every).alias("labels"),
        F.coalesce(F.array_max(F.transform(every, lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        F.size(every).cast("long").alias("n_detections"),
    )
