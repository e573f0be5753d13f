"""Signature rules for licenses: one a line, as ``license | priority | keywords | pattern``.

Patterns ignore case; a blank stands for any white space. All keywords of a
rule occur in whatever its pattern matches, so a text without them can skip the
rule. Priorities: 90 tags, 80 license texts, 70 notices, 60 addresses,
50 full names, 40 short names, 20 hints. Order decides between equals.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

TABLE = r"""
SPDX-tag | 90 | spdx | spdx-license-identifier: ?\(?[a-z0-9.+-]+(?: (?:and|or|with) \(?[a-z0-9.+-]+\)?)*\)?
SPDX-tag | 90 | spdx | spdx-filecopyrighttext:[^\n]+
MIT | 80 | permission | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
MIT | 80 | copyright | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
MIT-0 | 81 | permission | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the "?software"?\), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so\.(?! subject)
ISC | 80 | permission | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
0BSD | 80 | permission | permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\.
BSD-2-Clause | 78 | redistribution | redistribution and use in source and binary forms, with or without modification, are permitted provided that
BSD-3-Clause | 80 | endorse | neither the names? of [\s\S]{1,400}? nor the names of (?:its|their) contributors may be used to endorse or promote products
BSD-4-Clause | 81 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
Apache-2.0 | 80 | license,version | licensed under the apache license, version 2\.0 \(the "?license"?\); you may not use this file except in compliance with the license
Apache-2.0 | 79 | licen | unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an "?as is"? basis
Apache-1.1 | 80 | apache | this product includes software developed by the apache software foundation
GPL-2.0-only | 80 | gnu,version | gnu general public license as published by the free software foundation[,;] version 2(?! or)(?!\.\d)
GPL-2.0-or-later | 81 | gnu,version | gnu general public license as published by the free software foundation[,;] either version 2 of the license, or \(at your option\) any later version
GPL-3.0-only | 80 | gnu,version | gnu general public license as published by the free software foundation[,;] version 3(?! or)
GPL-3.0-or-later | 81 | gnu,version | gnu general public license as published by the free software foundation[,;] either version 3 of the license, or \(at your option\) any later version
LGPL-2.1-or-later | 81 | gnu,version | gnu lesser general public license as published by the free software foundation[,;] either version 2\.1 of the license, or \(at your option\) any later version
LGPL-2.0-or-later | 81 | gnu,version | gnu library general public license as published by the free software foundation[,;] either version 2 of the license, or \(at your option\) any later version
LGPL-3.0-or-later | 81 | gnu,version | gnu lesser general public license as published by the free software foundation[,;] either version 3 of the license, or \(at your option\) any later version
AGPL-3.0-or-later | 81 | affero,version | gnu affero general public license as published by the free software foundation[,;] either version 3 of the license, or \(at your option\) any later version
AGPL-3.0-only | 80 | affero,version | gnu affero general public license as published by the free software foundation[,;] version 3(?! or)
GPL-1.0-or-later | 79 | warranty | this program is distributed in the hope that it will be useful, but without any warranty
GPL-1.0-or-later | 79 | gnu | you should have received a copy of the gnu general public license along with this program
LGPL-2.0-or-later | 79 | gnu | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)
AGPL-3.0-or-later | 79 | affero | you should have received a copy of the gnu affero general public license along with this program
MPL-2.0 | 80 | mozilla | this source code form is subject to the terms of the mozilla public license,? v\. ?2\.0
MPL-1.1 | 80 | mozilla,version | the contents of this file are subject to the mozilla public license version 1\.1
MPL-1.0 | 80 | mozilla,version | the contents of this file are subject to the mozilla public license version 1\.0
NPL-1.1 | 80 | netscape | the contents of this file are subject to the netscape public license,? version 1\.1
EPL-1.0 | 80 | eclipse | made available under the terms of the eclipse public license v ?1\.0
EPL-2.0 | 80 | eclipse | made available under the terms of the eclipse public license v?(?:ersion)? ?2\.0
CDDL-1.0 | 80 | distribution | subject to the terms of the common development and distribution license(?:,? version 1\.0)?
CPL-1.0 | 80 | common,licen | made available under the terms of the common public license v ?1\.0
Zlib | 80 | altered | altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
Zlib | 80 | warranty | this software is provided '?as-is'?, without any express or implied warranty\. in no event will the authors be held liable
BSL-1.0 | 80 | boost | distributed under the boost software license, version 1\.0
BSL-1.0 | 80 | permission | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
Unlicense | 80 | unencumbered | this is free and unencumbered software released into the public domain
WTFPL | 80 | fuck | you just do what the fuck you want to
WTFPL | 81 | fuck | do what the fuck you want to public license
CC0-1.0 | 80 | copyright | to the extent possible under law, [\s\S]{1,400}? (?:has|have) waived all copyright and related or neighbou?ring rights
Python-2.0 | 80 | python | psf is making python available to licensee on an "?as is"? basis
Artistic-2.0 | 80 | artistic | you (?:may|can) (?:re)?distribute (?:it|this) and/or modify (?:it|this) under the terms of the artistic license 2\.0
Perl | 80 | perl | under the same terms as perl(?: itself)?
OpenSSL | 80 | openssl | this product includes software developed by the openssl project
SSLeay | 80 | cryptographic | this product includes cryptographic software written by eric young
NCSA | 80 | restriction | deal with the software without restriction, including without limitation the rights [\s\S]{1,400}? subject to the following conditions
PostgreSQL | 80 | permission | permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted
HPND | 80 | permission | permission to use, copy, modify,? and distribute this software and its documentation for any purpose (?:and|with or) without fee is hereby granted
X11 | 80 | consortium | except as contained in this notice, the name of the x consortium shall not be used in advertising
curl | 80 | permission | permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies\. the software is provided
OFL-1.1 | 80 | font | this font software is licensed under the sil open font license,? version 1\.1
Beerware | 80 | beer | if we meet some day, and you think this stuff is worth it, you can buy me a beer
JSON | 80 | evil | the software shall be used for good, not evil
Vim | 80 | vim | vim is charityware
BUSL-1.1 | 80 | licensor | licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the licensed work
SSPL-1.0 | 80 | server | server side public license(?:,)? version 1
Elastic-2.0 | 80 | elastic | elastic license 2\.0
Commons-Clause | 80 | clause | "?commons clause"? license condition v ?1\.0
MIT | 70 | licen | (?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:mit|expat|mit/x11|x11/mit) licen[cs]e\b
Apache-2.0 | 70 | apache,licen | (?:released|licensed|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e,? ?(?:version |v\.? ?)?2(?:\.0)?\b
Apache-1.1 | 70 | apache,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e,? ?(?:version |v\.? ?)?1\.1\b
Apache-1.0 | 70 | apache,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[cs]e,? ?(?:version |v\.? ?)?1\.0\b
GPL-3.0-only | 70 | general,public,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e,? ?(?:version |v\.? ?)?3(?:\.0)?\b(?! or)
GPL-2.0-only | 70 | general,public,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e,? ?(?:version |v\.? ?)?2(?:\.0)?\b(?! or)
GPL-3.0-or-later | 71 | general,public,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e,? ?(?:version |v\.? ?)?3(?:\.0)? or (?:any )?later
GPL-2.0-or-later | 71 | general,public,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e,? ?(?:version |v\.? ?)?2(?:\.0)? or (?:any )?later
GPL-3.0-only | 69 | gpl | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?:-| |,)*(?:version |v\.?)? ?3(?:\.0)?\b
GPL-2.0-only | 69 | gpl | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?:-| |,)*(?:version |v\.?)? ?2(?:\.0)?\b
LGPL-3.0-only | 70 | lesser,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?gnu lesser general public licen[cs]e,? ?(?:version |v\.? ?)?3(?:\.0)?\b
LGPL-2.1-only | 70 | lesser,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?gnu lesser general public licen[cs]e,? ?(?:version |v\.? ?)?2\.1\b
LGPL-2.0-only | 70 | library,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?gnu library general public licen[cs]e
AGPL-3.0-only | 70 | affero,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?gnu affero general public licen[cs]e,? ?(?:version |v\.? ?)?3?(?:\.0)?\b
BSD-3-Clause | 70 | bsd,licen | (?:released|licensed|distributed|available) under (?:the |a )?(?:terms of )?(?:the )?(?:new|modified|revised|three|3)[- ](?:clause )?(?:bsd|bsd-style) licen[cs]e
BSD-2-Clause | 70 | bsd,licen | (?:released|licensed|distributed|available) under (?:the |a )?(?:terms of )?(?:the )?(?:simplified|freebsd|two|2)[- ](?:clause )?bsd licen[cs]e
BSD-3-Clause | 69 | bsd,clause | (?:released|licensed|distributed|available) under (?:the |a )?(?:terms of )?(?:the )?bsd[- ]3[- ]clause
BSD-2-Clause | 69 | bsd,clause | (?:released|licensed|distributed|available) under (?:the |a )?(?:terms of )?(?:the )?bsd[- ]2[- ]clause
BSD | 68 | bsd,licen | (?:released|licensed|distributed|available) under (?:the |a )?(?:terms of )?(?:the )?bsd(?:-style)? licen[cs]e
MPL-2.0 | 70 | mozilla,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?mozilla public licen[cs]e,? ?(?:version |v\.? ?)?2\.0
MPL-1.1 | 70 | mozilla,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?mozilla public licen[cs]e,? ?(?:version |v\.? ?)?1\.1
EPL-2.0 | 70 | eclipse,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?eclipse public licen[cs]e,?(?: -)? ?(?:version |v\.? ?)?2\.0
EPL-1.0 | 70 | eclipse,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?eclipse public licen[cs]e,?(?: -)? ?(?:version |v\.? ?)?1\.0
ISC | 70 | isc,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?isc licen[cs]e
Zlib | 70 | zlib,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?zlib(?:/libpng)? licen[cs]e
BSL-1.0 | 70 | boost,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?boost(?: software)? licen[cs]e
Unlicense | 70 | unlicen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?unlicen[cs]e\b
EUPL-1.2 | 70 | european,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?european union public licen[cs]e
Artistic-2.0 | 70 | artistic,licen | (?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?artistic licen[cs]e,? ?(?:version |v\.? ?)?2(?:\.0)?
CC-BY-4.0 | 70 | creative | (?:released|licensed|distributed|available) under (?:the |a )?(?:terms of )?(?:the )?creative commons attribution 4\.0
CC-BY-SA-4.0 | 71 | creative | (?:released|licensed|distributed|available) under (?:the |a )?(?:terms of )?(?:the )?creative commons attribution[- ]share ?-?alike 4\.0
CC-BY-NC-4.0 | 71 | creative | (?:released|licensed|distributed|available) under (?:the |a )?(?:terms of )?(?:the )?creative commons attribution[- ]non-?commercial 4\.0
CC-BY-NC-SA-4.0 | 72 | creative | (?:released|licensed|distributed|available) under (?:the |a )?(?:terms of )?(?:the )?creative commons attribution[- ]non-?commercial[- ]share ?-?alike 4\.0
CC-BY-ND-4.0 | 71 | creative | (?:released|licensed|distributed|available) under (?:the |a )?(?:terms of )?(?:the )?creative commons attribution[- ]no-?deriv(?:ative)?s 4\.0
CC-BY-NC-ND-4.0 | 72 | creative | (?:released|licensed|distributed|available) under (?:the |a )?(?:terms of )?(?:the )?creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s 4\.0
CC-BY-NC-SA-4.0 | 72 | 4.0 | (?:released|licensed|distributed|available) under (?:the |a )?cc[- ]by[- ]nc[- ]sa[- ]4\.0
CC-BY-NC-ND-4.0 | 72 | 4.0 | (?:released|licensed|distributed|available) under (?:the |a )?cc[- ]by[- ]nc[- ]nd[- ]4\.0
CC-BY-NC-4.0 | 71 | 4.0 | (?:released|licensed|distributed|available) under (?:the |a )?cc[- ]by[- ]nc[- ]4\.0
CC-BY-SA-4.0 | 71 | 4.0 | (?:released|licensed|distributed|available) under (?:the |a )?cc[- ]by[- ]sa[- ]4\.0
CC-BY-ND-4.0 | 71 | 4.0 | (?:released|licensed|distributed|available) under (?:the |a )?cc[- ]by[- ]nd[- ]4\.0
CC-BY-4.0 | 70 | 4.0 | (?:released|licensed|distributed|available) under (?:the |a )?cc[- ]by[- ]4\.0
CC-BY-NC-SA-3.0 | 72 | 3.0 | (?:released|licensed|distributed|available) under (?:the |a )?cc[- ]by[- ]nc[- ]sa[- ]3\.0
CC-BY-NC-3.0 | 71 | 3.0 | (?:released|licensed|distributed|available) under (?:the |a )?cc[- ]by[- ]nc[- ]3\.0
CC-BY-SA-3.0 | 71 | 3.0 | (?:released|licensed|distributed|available) under (?:the |a )?cc[- ]by[- ]sa[- ]3\.0
CC-BY-3.0 | 70 | 3.0 | (?:released|licensed|distributed|available) under (?:the |a )?cc[- ]by[- ]3\.0
CC-BY-SA-2.0 | 71 | 2.0 | (?:released|licensed|distributed|available) under (?:the |a )?cc[- ]by[- ]sa[- ]2\.0
CC-BY-2.0 | 70 | 2.0 | (?:released|licensed|distributed|available) under (?:the |a )?cc[- ]by[- ]2\.0
CC0-1.0 | 70 | cc0 | (?:released|licensed|distributed|available|dedicated) under (?:the )?(?:creative commons )?cc0(?:[- ]1\.0)?
GFDL-1.3 | 70 | documentation,licen | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license,? version 1\.3
GFDL-1.2 | 70 | documentation,licen | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license,? version 1\.2
GFDL-1.1 | 70 | documentation,licen | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license,? version 1\.1
ODbL-1.0 | 70 | database,licen | (?:made|is) available under the open database licen[cs]e
ODC-By-1.0 | 70 | attribution,licen | (?:made|is) available under the open data commons attribution licen[cs]e
PDDL-1.0 | 70 | dedication,licen | (?:made|is) available under the public domain dedication and licen[cs]e
Proprietary | 70 | rights | all rights reserved\.? (?:unauthori[sz]ed|no part|reproduction)
Proprietary | 70 | proprietary | (?:proprietary and confidential|confidential and proprietary)
Proprietary | 70 | copying | unauthori[sz]ed copying of this file, via any medium,? is strictly prohibited
Proprietary | 70 | permission | may not be (?:reproduced|copied|redistributed) (?:in any form )?without (?:the )?(?:prior |express )?(?:written )?permission
Research-only | 70 | academic | for academic (?:research )?(?:use|purposes) only
Research-only | 70 | research | for research (?:use|purposes) only
Research-only | 70 | commercial | for non-?commercial (?:research )?(?:use|purposes) only
Public-domain | 70 | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
Apache-2.0 | 60 | apache | https?://www\.apache\.org/licenses/license-2\.0(?:\.txt|\.html)?
Apache-1.1 | 60 | apache | https?://www\.apache\.org/licenses/license-1\.1
MIT | 60 | opensource | https?://(?:www\.)?opensource\.org/licenses?/mit(?:-license)?(?:\.php|\.html)?
MIT | 60 | mit-license | https?://(?:www\.)?mit-license\.org
BSD-3-Clause | 60 | opensource | https?://(?:www\.)?opensource\.org/licenses?/bsd-3-clause
BSD-2-Clause | 60 | opensource | https?://(?:www\.)?opensource\.org/licenses?/bsd-2-clause
ISC | 60 | opensource | https?://(?:www\.)?opensource\.org/licenses?/isc(?:-license)?
GPL-2.0-only | 60 | opensource | https?://(?:www\.)?opensource\.org/licenses?/gpl-2\.0
GPL-3.0-only | 60 | opensource | https?://(?:www\.)?opensource\.org/licenses?/gpl-3\.0
MPL-2.0 | 60 | mpl | https?://(?:www\.)?mozilla\.org/(?:en-us/)?mpl/2\.0/?
MPL-1.1 | 60 | mpl | https?://(?:www\.)?mozilla\.org/mpl/(?:mpl-)?1\.1
GPL-3.0-only | 60 | gpl | https?://www\.gnu\.org/licenses/gpl-3\.0(?:\.(?:txt|html|en\.html))?
GPL-2.0-only | 60 | gpl | https?://www\.gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.(?:txt|html|en\.html))?
GPL-1.0-or-later | 59 | gnu | https?://www\.gnu\.org/(?:licenses/?(?:gpl\.html)?|copyleft/gpl\.html)
LGPL-3.0-only | 60 | lgpl | https?://www\.gnu\.org/licenses/lgpl-3\.0(?:\.(?:txt|html|en\.html))?
LGPL-2.1-only | 60 | lgpl | https?://www\.gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1(?:\.(?:txt|html|en\.html))?
AGPL-3.0-only | 60 | agpl | https?://www\.gnu\.org/licenses/agpl-3\.0(?:\.(?:txt|html|en\.html))?
GFDL-1.3 | 60 | fdl | https?://www\.gnu\.org/licenses/fdl-1\.3(?:\.(?:txt|html|en\.html))?
EPL-1.0 | 60 | eclipse | https?://www\.eclipse\.org/(?:legal|org/documents)/epl-v10(?:\.html|\.php)?
EPL-2.0 | 60 | eclipse | https?://www\.eclipse\.org/(?:legal|org/documents)/epl-(?:2\.0|v20)(?:/|\.html)?
BSL-1.0 | 60 | boost | https?://www\.boost\.org/license_1_0\.txt
Unlicense | 60 | unlicense | https?://unlicense\.org/?
WTFPL | 60 | wtfpl | https?://(?:www\.|sam\.zoy\.org/)wtfpl(?:\.net)?
OFL-1.1 | 60 | ofl | https?://scripts\.sil\.org/ofl
CC0-1.0 | 60 | creativecommons | https?://creativecommons\.org/publicdomain/zero/1\.0/?
CC-PDM-1.0 | 60 | creativecommons | https?://creativecommons\.org/publicdomain/mark/1\.0/?
CC-BY-4.0 | 60 | creativecommons | https?://creativecommons\.org/licenses/by/4\.0/?
CC-BY-SA-4.0 | 60 | creativecommons | https?://creativecommons\.org/licenses/by-sa/4\.0/?
CC-BY-NC-4.0 | 60 | creativecommons | https?://creativecommons\.org/licenses/by-nc/4\.0/?
CC-BY-ND-4.0 | 60 | creativecommons | https?://creativecommons\.org/licenses/by-nd/4\.0/?
CC-BY-NC-SA-4.0 | 60 | creativecommons | https?://creativecommons\.org/licenses/by-nc-sa/4\.0/?
CC-BY-NC-ND-4.0 | 60 | creativecommons | https?://creativecommons\.org/licenses/by-nc-nd/4\.0/?
CC-BY-3.0 | 60 | creativecommons | https?://creativecommons\.org/licenses/by/3\.0(?:/[a-z]{2})?/?
CC-BY-SA-3.0 | 60 | creativecommons | https?://creativecommons\.org/licenses/by-sa/3\.0(?:/[a-z]{2})?/?
CC-BY-NC-3.0 | 60 | creativecommons | https?://creativecommons\.org/licenses/by-nc/3\.0(?:/[a-z]{2})?/?
CC-BY-ND-3.0 | 60 | creativecommons | https?://creativecommons\.org/licenses/by-nd/3\.0(?:/[a-z]{2})?/?
CC-BY-NC-SA-3.0 | 60 | creativecommons | https?://creativecommons\.org/licenses/by-nc-sa/3\.0(?:/[a-z]{2})?/?
CC-BY-NC-ND-3.0 | 60 | creativecommons | https?://creativecommons\.org/licenses/by-nc-nd/3\.0(?:/[a-z]{2})?/?
CC-BY-2.0 | 60 | creativecommons | https?://creativecommons\.org/licenses/by/2\.0/?
CC-BY-SA-2.0 | 60 | creativecommons | https?://creativecommons\.org/licenses/by-sa/2\.0/?
CC-BY-2.5 | 60 | creativecommons | https?://creativecommons\.org/licenses/by/2\.5/?
CC-BY-SA-2.5 | 60 | creativecommons | https?://creativecommons\.org/licenses/by-sa/2\.5/?
ODbL-1.0 | 60 | odbl | https?://opendatacommons\.org/licenses/odbl/?(?:1\.0|1-0)?/?
PDDL-1.0 | 60 | pddl | https?://opendatacommons\.org/licenses/pddl/?(?:1\.0|1-0)?/?
OGL-UK-3.0 | 60 | licence | https?://www\.nationalarchives\.gov\.uk/doc/open-government-licence/version/3/?
EUPL-1.2 | 60 | eupl | https?://(?:joinup\.ec\.europa\.eu|ec\.europa\.eu)/\S*eupl\S*
Apache-2.0 | 50 | apache,licen | \bapache(?: software)? licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?\b
Apache-1.1 | 50 | apache,licen | \bapache(?: software)? licen[cs]e,? (?:version |v\.? ?)?1\.1\b
Apache-1.0 | 50 | apache,licen | \bapache(?: software)? licen[cs]e,? (?:version |v\.? ?)?1\.0\b
GPL-3.0-only | 50 | general,public,licen | \bgnu general public licen[cs]e,? \(?(?:gpl,? )?(?:version |v\.? ?)?3(?:\.0)?\b
GPL-2.0-only | 50 | general,public,licen | \bgnu general public licen[cs]e,? \(?(?:gpl,? )?(?:version |v\.? ?)?2(?:\.0)?\b
GPL-1.0-only | 50 | general,public,licen | \bgnu general public licen[cs]e,? \(?(?:version |v\.? ?)?1(?:\.0)?\b
GPL-3.0-or-later | 51 | general,public,licen | \bgnu general public licen[cs]e,? (?:version |v\.? ?)?3(?:\.0)?,? or (?:\(at your option\) )?(?:any )?later
GPL-2.0-or-later | 51 | general,public,licen | \bgnu general public licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?,? or (?:\(at your option\) )?(?:any )?later
LGPL-3.0-only | 50 | lesser,licen | \bgnu lesser general public licen[cs]e,? (?:version |v\.? ?)?3(?:\.0)?\b
LGPL-2.1-only | 50 | lesser,licen | \bgnu lesser general public licen[cs]e,? (?:version |v\.? ?)?2\.1\b
LGPL-2.0-only | 50 | library,licen | \bgnu library general public licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?\b
AGPL-3.0-only | 50 | affero,licen | \bgnu affero general public licen[cs]e,? (?:version |v\.? ?)?3(?:\.0)?\b
AGPL-1.0-only | 50 | affero,licen | \baffero general public licen[cs]e,? (?:version |v\.? ?)?1(?:\.0)?\b
GFDL-1.3 | 50 | documentation,licen | \bgnu free documentation licen[cs]e,? (?:version |v\.? ?)?1\.3\b
GFDL-1.2 | 50 | documentation,licen | \bgnu free documentation licen[cs]e,? (?:version |v\.? ?)?1\.2\b
MPL-2.0 | 50 | mozilla,licen | \bmozilla public licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?\b
MPL-1.1 | 50 | mozilla,licen | \bmozilla public licen[cs]e,? (?:version |v\.? ?)?1\.1\b
MPL-1.0 | 50 | mozilla,licen | \bmozilla public licen[cs]e,? (?:version |v\.? ?)?1\.0\b
EPL-2.0 | 50 | eclipse,licen | \beclipse public licen[cs]e,?(?: -)? (?:version |v\.? ?)?2(?:\.0)?\b
EPL-1.0 | 50 | eclipse,licen | \beclipse public licen[cs]e,?(?: -)? (?:version |v\.? ?)?1(?:\.0)?\b
CDDL-1.1 | 50 | distribution,licen | \bcommon development and distribution licen[cs]e,? (?:version |v\.? ?)?1\.1\b
CDDL-1.0 | 50 | distribution,licen | \bcommon development and distribution licen[cs]e(?:,? (?:version |v\.? ?)?1\.0)?\b
CPL-1.0 | 50 | common,licen | \bcommon public licen[cs]e(?:,? (?:version |v\.? ?)?1\.0)?\b
CPAL-1.0 | 50 | attribution,licen | \bcommon public attribution licen[cs]e\b
IPL-1.0 | 50 | ibm,licen | \bibm public licen[cs]e\b
APSL-2.0 | 50 | apple,licen | \bapple public source licen[cs]e\b
MS-PL | 50 | microsoft,licen | \bmicrosoft public licen[cs]e\b
MS-RL | 50 | microsoft,licen | \bmicrosoft reciprocal licen[cs]e\b
EUPL-1.2 | 50 | european,licen | \beuropean union public licen[cs]e,? (?:version |v\.? ?)?1\.2\b
EUPL-1.1 | 50 | european,licen | \beuropean union public licen[cs]e,? (?:version |v\.? ?)?1\.1\b
OSL-3.0 | 50 | open,licen | \bopen software licen[cs]e(?:,? (?:version |v\.? ?)?3\.0)?\b
AFL-3.0 | 50 | academic,licen | \bacademic free licen[cs]e(?:,? (?:version |v\.? ?)?\d\.\d)?\b
ECL-2.0 | 50 | educational,licen | \beducational community licen[cs]e(?:,? (?:version |v\.? ?)?2\.0)?\b
CECILL-2.1 | 50 | cecill | \bcecill(?:[- ]?[bc])?(?: free software)?(?: licen[cs]e)?(?: v?2\.[01])?\b
BSL-1.0 | 50 | boost,licen | \bboost software licen[cs]e\b
BUSL-1.1 | 50 | business,licen | \bbusiness source licen[cs]e(?: 1\.1)?\b
SSPL-1.0 | 50 | server,licen | \bserver side public licen[cs]e\b
Artistic-2.0 | 50 | artistic,licen | \bartistic licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?\b
Artistic-1.0 | 49 | artistic,licen | \bartistic licen[cs]e\b
PSF-2.0 | 50 | python,licen | \bpython software foundation licen[cs]e(?: version 2)?\b
PHP-3.01 | 50 | php,licen | \bphp licen[cs]e,? (?:version |v\.? ?)?3\.01\b
PHP-3.0 | 49 | php,licen | \bphp licen[cs]e\b
Ruby | 50 | ruby,licen | \bruby licen[cs]e\b
OpenSSL | 50 | openssl,licen | \bopenssl licen[cs]e\b
W3C | 50 | w3c,licen | \bw3c software(?: notice and)? licen[cs]e\b
Sleepycat | 50 | sleepycat,licen | \bsleepycat licen[cs]e\b
NCSA | 50 | illinois,licen | \buniversity of illinois/?ncsa open source licen[cs]e\b
UPL-1.0 | 50 | universal,licen | \buniversal permissive licen[cs]e\b
QPL-1.0 | 50 | public,licen | \bq public licen[cs]e\b
OFL-1.1 | 50 | font,licen | \b(?:sil )?open font licen[cs]e(?:,? (?:version |v\.? ?)?1\.1)?\b
LPPL-1.3c | 50 | latex,licen | \blatex project public licen[cs]e(?:,? (?:version |v\.? ?)?1\.3c?)?\b
NASA-1.3 | 50 | nasa,licen | \bnasa open source agreement\b[\s\S]{0,60}?licen[cs]e
Intel | 50 | intel,licen | \bintel open source licen[cs]e\b
RPL-1.5 | 50 | reciprocal,licen | \breciprocal public licen[cs]e\b
SPL-1.0 | 50 | sun,licen | \bsun public licen[cs]e\b
SISSL | 50 | sun,licen | \bsun industry standards source licen[cs]e\b
Watcom-1.0 | 50 | sybase,licen | \bsybase open watcom public licen[cs]e\b
ZPL-2.1 | 50 | zope,licen | \bzope public licen[cs]e\b
MulanPSL-2.0 | 50 | mulan,licen | \bmulan permissive software licen[cs]e\b
OGL-UK-3.0 | 50 | government,licen | \bopen government licen[cs]e(?: v?3\.0)?\b
ODbL-1.0 | 50 | database,licen | \bopen database licen[cs]e\b
ODC-By-1.0 | 50 | commons,licen | \bopen data commons attribution licen[cs]e\b
CDLA-Permissive-2.0 | 50 | community,licen | \bcommunity data licen[cs]e agreement(?: [-–])? permissive\b
CDLA-Sharing-1.0 | 50 | community,licen | \bcommunity data licen[cs]e agreement(?: [-–])? sharing\b
Llama-community | 50 | llama,licen | \bllama \d(?:\.\d)? community licen[cs]e\b
OpenRAIL | 50 | openrail | \b(?:creativeml |bigscience |bigcode )?open(?:rail|rail\+\+)(?:-m)?(?: licen[cs]e)?\b
CC-BY-NC-SA | 52 | creative | \bcreative commons attribution[- ]non-?commercial[- ]share ?-?alike\b
CC-BY-NC-ND | 52 | creative | \bcreative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s\b
CC-BY-NC | 51 | creative | \bcreative commons attribution[- ]non-?commercial\b
CC-BY-SA | 51 | creative | \bcreative commons attribution[- ]share ?-?alike\b
CC-BY-ND | 51 | creative | \bcreative commons attribution[- ]no-?deriv(?:ative)?s\b
CC-BY | 50 | creative | \bcreative commons attribution\b
CC0-1.0 | 50 | creative | \bcreative commons zero\b
MIT | 50 | mit,licen | \b(?:the )?mit licen[cs]e\b(?! plate)
MIT | 49 | expat,licen | \bexpat licen[cs]e\b
X11 | 49 | licen | \bx11 licen[cs]e\b
MIT-0 | 50 | mit,attribution | \bmit no attribution\b
ISC | 50 | isc,licen | \bisc licen[cs]e\b
Zlib | 50 | zlib,licen | \bzlib(?:/libpng)? licen[cs]e\b
BSD-3-Clause | 50 | bsd,licen | \b(?:3[- ]clause|new|modified|revised) bsd licen[cs]e\b
BSD-2-Clause | 50 | bsd,licen | \b(?:2[- ]clause|simplified|freebsd) bsd licen[cs]e\b
BSD-4-Clause | 50 | bsd,licen | \b(?:4[- ]clause|original) bsd licen[cs]e\b
0BSD | 50 | bsd | \b(?:zero[- ]clause bsd|bsd zero[- ]clause|0bsd)\b
BSD | 49 | bsd,licen | \bbsd(?:-style)? licen[cs]e\b
GPL-3.0-or-later | 42 | gpl | \bgpl[- ]?v?3(?:\.0)?(?:\+|-or-later)
GPL-2.0-or-later | 42 | gpl | \bgpl[- ]?v?2(?:\.0)?(?:\+|-or-later)
GPL-3.0-only | 40 | gpl | \b(?<!a)(?<!l)gpl[- ]?v?3(?:\.0)?(?:-only)?\b
GPL-2.0-only | 40 | gpl | \b(?<!a)(?<!l)gpl[- ]?v?2(?:\.0)?(?:-only)?\b
LGPL-3.0-only | 41 | lgpl | \blgpl[- ]?v?3(?:\.0)?(?:-only)?\b
LGPL-2.1-only | 41 | lgpl | \blgpl[- ]?v?2\.1(?:-only)?\b
LGPL-2.0-only | 41 | lgpl | \blgpl[- ]?v?2(?:\.0)?(?:-only)?\b
AGPL-3.0-only | 41 | agpl | \bagpl[- ]?v?3(?:\.0)?(?:-only)?\b
MPL-2.0 | 40 | mpl | \bmpl[- ]?v?2(?:\.0)?\b
MPL-1.1 | 40 | mpl | \bmpl[- ]?v?1\.1\b
EPL-2.0 | 40 | epl | \bepl[- ]v?2\.0\b
EPL-1.0 | 40 | epl | \bepl[- ]v?1\.0\b
CC-BY-NC-SA-4.0 | 43 | 4.0 | \bcc[- ]by[- ]nc[- ]sa[- ]4\.0\b
CC-BY-NC-ND-4.0 | 43 | 4.0 | \bcc[- ]by[- ]nc[- ]nd[- ]4\.0\b
CC-BY-NC-4.0 | 42 | 4.0 | \bcc[- ]by[- ]nc[- ]4\.0\b
CC-BY-SA-4.0 | 42 | 4.0 | \bcc[- ]by[- ]sa[- ]4\.0\b
CC-BY-ND-4.0 | 42 | 4.0 | \bcc[- ]by[- ]nd[- ]4\.0\b
CC-BY-4.0 | 41 | 4.0 | \bcc[- ]by[- ]4\.0\b
CC-BY-NC-SA-3.0 | 43 | 3.0 | \bcc[- ]by[- ]nc[- ]sa[- ]3\.0\b
CC-BY-NC-3.0 | 42 | 3.0 | \bcc[- ]by[- ]nc[- ]3\.0\b
CC-BY-SA-3.0 | 42 | 3.0 | \bcc[- ]by[- ]sa[- ]3\.0\b
CC-BY-3.0 | 41 | 3.0 | \bcc[- ]by[- ]3\.0\b
CC0-1.0 | 40 | cc0 | \bcc0(?:[- ]1\.0)?\b
Public-domain | 40 | domain | \b(?:in|into|to) the public domain\b
Unlicense | 40 | unlicense | \bthe unlicense\b
WTFPL | 40 | wtfpl | \bwtfpl\b
OFL-1.1 | 40 | ofl | \bofl[- ]1\.1\b
GPL | 30 | general,public,licen | \bgnu general public licen[cs]e\b
LGPL | 31 | lesser,licen | \bgnu lesser general public licen[cs]e\b
AGPL | 31 | affero,licen | \b(?:gnu )?affero general public licen[cs]e\b
GFDL | 31 | documentation,licen | \bgnu free documentation licen[cs]e\b
Apache | 30 | apache,licen | \bapache(?: software)? licen[cs]e\b
MPL | 30 | mozilla,licen | \bmozilla public licen[cs]e\b
EPL | 30 | eclipse,licen | \beclipse public licen[cs]e\b
EUPL | 30 | european,licen | \beuropean union public licen[cs]e\b
GPL | 29 | gpl | \bgnu gpl\b
LGPL | 29 | lgpl | \b(?:gnu )?lgpl\b
AGPL | 29 | agpl | \b(?:gnu )?agpl\b
Creative-Commons | 29 | creative,licen | \bcreative commons licen[cs]e\b
Proprietary | 28 | rights | \ball rights reserved\b
Copyright-notice | 25 | copyright | \bcopyright (?:\(c\)|©)? ?(?:19|20)\d\d(?:[-–, ]+(?:19|20)\d\d)*\b
Copyright-notice | 24 | (c) | \(c\) (?:copyright )?(?:19|20)\d\d\b
Warranty-disclaimer | 22 | warrant | \bwithout warrant(?:y|ies) (?:or conditions )?of any kind\b
Warranty-disclaimer | 22 | warrant | \bdisclaims? all warranties\b
License-reference | 20 | licen | \bsee (?:the )?(?:accompanying )?licen[cs]e(?:\.(?:txt|md))? (?:file )?for (?:the )?(?:details|terms|more information)\b
License-reference | 20 | licen | \b(?:released|licensed|distributed) under (?:the |an? )?(?:[\w.+-]+ ){0,5}?licen[cs]e\b
License-reference | 19 | licen | \bsubject to (?:the )?(?:terms|license terms) (?:and conditions )?of (?:the |this )?licen[cs]e\b
"""


@dataclass(frozen=True)
class Rule:
    number: int
    license: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str


def _rules() -> list[Rule]:
    out = []
    for line in TABLE.strip().splitlines():
        license_, priority, keywords, pattern = line.split(" | ", 3)
        flexible = re.sub(r"(?<!\[) (?!\])", r"\\s+", pattern)
        flexible = flexible.replace(r"\s+?", r"\s*").replace(r"\s++", r"\s+")
        out.append(Rule(len(out), license_, int(priority), tuple(keywords.split(",")), flexible))
    return out


RULES = _rules()
