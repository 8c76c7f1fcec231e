"""The signature rules of license scans, written by hand: a line is label | keyword | pattern.

Patterns stand over lower-case words joined by single spaces; ``~`` is "license" or "licence". The keyword must occur
in a text before the pattern is tried. The groups come from best to least priority.
"""

#: Wording of licence texts and of notices that name one.
TEXT = """
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | under the mit | (?:licensed|released|distributed|available) under the mit ~
isc | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | endorse or promote | neither the name of [^ ]+(?: [^ ]+){0,12} may be used to endorse or promote products derived from this software
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display
apache-2.0 | licensed under the apache | licensed under the apache ~ version 2 0
apache-2.0 | terms and conditions for use reproduction | apache ~ version 2 0 january 2004(?: [^ ]+){0,4} terms and conditions for use reproduction and distribution
apache-2.0 | except in compliance with | you may not use this file except in compliance with the ~
apache-1.1 | developed by the apache software foundation | this product includes software developed by the apache software foundation
gpl | gnu general public | this program is free software you can redistribute it and or modify it under the terms of the gnu general public ~
gpl | take away your freedom | the licenses for most software are designed to take away your freedom to share and change it
gpl | without even the implied warranty | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public ~
gpl-1-or-later | general public | general public ~ (?:as published by the free software foundation )?(?:either )?version 1(?: 0)? (?:of the ~ )?or (?:at your option )?any later version
gpl-2-or-later | general public | general public ~ (?:as published by the free software foundation )?(?:either )?version 2(?: 0)? (?:of the ~ )?or (?:at your option )?any later version
gpl-3-or-later | general public | general public ~ (?:as published by the free software foundation )?(?:either )?version 3(?: 0)? (?:of the ~ )?or (?:at your option )?any later version
lgpl-2-or-later | library general public | library general public ~ (?:as published by the free software foundation )?(?:either )?version 2(?: 0)? (?:of the ~ )?or (?:at your option )?any later version
lgpl-2.1-or-later | lesser general public | lesser general public ~ (?:as published by the free software foundation )?(?:either )?version 2 1 (?:of the ~ )?or (?:at your option )?any later version
lgpl-3-or-later | lesser general public | lesser general public ~ (?:as published by the free software foundation )?(?:either )?version 3(?: 0)? (?:of the ~ )?or (?:at your option )?any later version
agpl-3-or-later | affero general public | affero general public ~ (?:as published by the free software foundation )?(?:either )?version 3(?: 0)? (?:of the ~ )?or (?:at your option )?any later version
gfdl-1.2-or-later | free documentation | free documentation ~ (?:either )?version 1 2 or (?:at your option )?any later version
gfdl-1.3-or-later | free documentation | free documentation ~ (?:either )?version 1 3 or (?:at your option )?any later version
mpl-1.1 | mozilla public | the contents of this file are subject to the mozilla public ~ version 1 1
mpl-2.0 | source code form | this source code form is subject to the terms of the mozilla public ~ v 2 0
epl-1.0 | eclipse public | the accompanying materials are made available under the terms of the eclipse public ~ v ?1 0
epl-2.0 | eclipse public | the accompanying materials are made available under the terms of the eclipse public ~ v? ?2 0
cddl-1.0 | common development and distribution | the contents of this file are subject to the terms of the common development and distribution ~
cpl-1.0 | common public | the accompanying program is provided under the terms of this common public ~
eupl | under the eupl | licensed under the eupl(?: version)? 1 [0-2]
zlib | altered source versions | altered source versions must be plainly marked as such and must not be misrepresented
zlib | held liable for any damages | in no event will the authors be held liable for any damages arising from the use of this software
boost | machine executable object code | must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code
unlicense | unencumbered software | this is free and unencumbered software released into the public domain
wtfpl | what the | do what the [^ ]+ you want to public ~
wtfpl | you just do what the | you just do what the [^ ]+ you want to
ncsa | university of illinois | developed by [^ ]+(?: [^ ]+){0,8} university of illinois
postgresql | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ofl-1.1 | sil open font | this font software is licensed under the sil open font ~ version 1 1
x11 | shall not be used in advertising | shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization
curl | use copy modify and distribute | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that
psf-2.0 | psf hereby grants | psf hereby grants ~e a nonexclusive royalty free world wide ~
artistic-1.0 | semblance of artistic control | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
sspl-1.0 | available to third parties as a service | if you make the functionality of the program or a modified version available to third parties as a service
busl-1.1 | make non production use | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
elastic-2.0 | hosted or managed service | you may not provide the software to third parties as a hosted or managed service
commons-clause | does not grant to you the right to sell | the ~ does not grant to you the right to sell the software
cc-by-4.0 | creative commons attribution | licensed under a creative commons attribution 4 0 international ~
cc-by-sa-4.0 | creative commons attribution | licensed under a creative commons attribution sharealike 4 0 international ~
cc-by-nc-4.0 | creative commons attribution | licensed under a creative commons attribution noncommercial 4 0 international ~
cc-by-3.0 | creative commons attribution | licensed under a creative commons attribution 3 0 unported ~
cc-by-sa-3.0 | creative commons attribution | licensed under a creative commons attribution sharealike 3 0 unported ~
cc0-1.0 | waived all copyright | has waived all copyright and related or neighboring rights to
"""

#: Exact identifiers, and addresses of licence texts.
SPDX = """
mit-0 | mit 0 | mit 0
mit-0 | mit no attribution | mit no attribution(?: ~)?
x11 | spdx license identifier x11 | spdx license identifier x11
isc | spdx license identifier isc | spdx license identifier isc
mit | spdx license identifier mit | spdx license identifier mit
0bsd | 0bsd | 0bsd
bsd-2-clause | bsd 2 clause | bsd 2 clause
bsd-3-clause | bsd 3 clause | bsd 3 clause
bsd-3-clause-clear | bsd 3 clause clear | bsd 3 clause clear
bsd-4-clause | bsd 4 clause | bsd 4 clause
apache-1.0 | apache 1 0 | apache 1 0
apache-1.1 | apache 1 1 | apache 1 1
apache-2.0 | apache 2 | apache 2(?: 0)?
apache-2.0 | apache org licenses | (?:https? )?www apache org licenses license 2 0
gpl-1 | gpl 1 | gpl 1(?: 0)?(?: only)?
gpl-2 | gpl 2 | gpl 2(?: 0)?(?: only)?
gpl-3 | gpl 3 | gpl 3(?: 0)?(?: only)?
gpl-1 | gpl | gpl ?v1(?: 0)?(?: only)?
gpl-2 | gpl | gpl ?v2(?: 0)?(?: only)?
gpl-3 | gpl | gpl ?v3(?: 0)?(?: only)?
gpl-1-or-later | gpl 1 | gpl 1(?: 0)? or later
gpl-2-or-later | gpl 2 | gpl 2(?: 0)? or later
gpl-3-or-later | gpl 3 | gpl 3(?: 0)? or later
gpl-2-or-later | gplv2 | gplv2 or later
gpl-3-or-later | gplv3 | gplv3 or later
gpl-2 | gnu org licenses | gnu org licenses old licenses gpl 2 0
gpl-3 | gnu org licenses | gnu org licenses gpl 3 0
lgpl-2 | lgpl 2 | lgpl 2(?: 0)?(?: only)?
lgpl-2.1 | lgpl 2 1 | lgpl 2 1(?: only)?
lgpl-3 | lgpl 3 | lgpl 3(?: 0)?(?: only)?
lgpl-2 | lgpl | lgpl ?v2(?: 0)?
lgpl-2.1 | lgpl | lgpl ?v2 1
lgpl-3 | lgpl | lgpl ?v3(?: 0)?
lgpl-2-or-later | lgpl 2 | lgpl 2(?: 0)? or later
lgpl-2.1-or-later | lgpl 2 1 | lgpl 2 1 or later
lgpl-3-or-later | lgpl 3 | lgpl 3(?: 0)? or later
agpl-1 | agpl 1 | agpl 1(?: 0)?(?: only)?
agpl-3 | agpl 3 | agpl 3(?: 0)?(?: only)?
agpl-3 | agpl | agpl ?v3(?: 0)?
agpl-3-or-later | agpl 3 | agpl 3(?: 0)? or later
agpl-3 | gnu org licenses | gnu org licenses agpl 3 0
gfdl-1.1 | gfdl 1 1 | gfdl 1 1(?: only)?
gfdl-1.2 | gfdl 1 2 | gfdl 1 2(?: only)?
gfdl-1.3 | gfdl 1 3 | gfdl 1 3(?: only)?
gfdl-1.3-or-later | gfdl 1 3 | gfdl 1 3 or later
mpl-1.0 | mpl 1 0 | mpl 1 0
mpl-1.1 | mpl 1 1 | mpl 1 1
mpl-2.0 | mpl 2 0 | mpl 2 0
mpl-2.0 | mpl | mpl ?v2(?: 0)?
mpl-2.0 | mozilla org mpl | mozilla org mpl 2 0
epl-1.0 | epl 1 0 | epl 1 0
epl-2.0 | epl 2 0 | epl 2 0
epl-1.0 | eclipse org legal | eclipse org legal epl v10
epl-2.0 | eclipse org legal | eclipse org legal epl 2 0
edl-1.0 | eclipse org org documents edl | eclipse org org documents edl v10
cddl-1.0 | cddl 1 0 | cddl 1 0
cddl-1.1 | cddl 1 1 | cddl 1 1
cpl-1.0 | cpl 1 0 | cpl 1 0
eupl-1.0 | eupl 1 0 | eupl 1 0
eupl-1.1 | eupl 1 1 | eupl 1 1
eupl-1.2 | eupl 1 2 | eupl 1 2
osl-1.0 | osl 1 0 | osl 1 0
osl-2.0 | osl 2 0 | osl 2 0
osl-2.1 | osl 2 1 | osl 2 1
osl-3.0 | osl 3 0 | osl 3 0
afl-1.1 | afl 1 1 | afl 1 1
afl-1.2 | afl 1 2 | afl 1 2
afl-2.0 | afl 2 0 | afl 2 0
afl-2.1 | afl 2 1 | afl 2 1
afl-3.0 | afl 3 0 | afl 3 0
artistic-1.0 | artistic 1 0 | artistic 1 0(?: perl)?
artistic-2.0 | artistic 2 0 | artistic 2 0
boost-1.0 | bsl 1 0 | bsl 1 0
boost-1.0 | boost org license | boost org license 1 0
ofl-1.0 | ofl 1 0 | ofl 1 0
ofl-1.1 | ofl 1 1 | ofl 1 1
ofl-1.1 | scripts sil org ofl | scripts sil org ofl
odbl-1.0 | odbl 1 0 | odbl 1 0
odc-by-1.0 | odc by 1 0 | odc by 1 0
pddl-1.0 | pddl 1 0 | pddl 1 0
cc0-1.0 | cc0 | cc0 1 0(?: universal)?
cc0 | cc0 | cc0
cc0-1.0 | publicdomain zero | creativecommons org publicdomain zero 1 0
cc-pdm-1.0 | publicdomain mark | creativecommons org publicdomain mark 1 0
cc-by-1.0 | cc by | cc by 1 0
cc-by-2.0 | cc by | cc by 2 0
cc-by-2.5 | cc by | cc by 2 5
cc-by-3.0 | cc by | cc by 3 0
cc-by-4.0 | cc by | cc by 4 0
cc-by-sa-1.0 | cc by sa | cc by sa 1 0
cc-by-sa-2.0 | cc by sa | cc by sa 2 0
cc-by-sa-2.5 | cc by sa | cc by sa 2 5
cc-by-sa-3.0 | cc by sa | cc by sa 3 0
cc-by-sa-4.0 | cc by sa | cc by sa 4 0
cc-by-nd-3.0 | cc by nd | cc by nd 3 0
cc-by-nd-4.0 | cc by nd | cc by nd 4 0
cc-by-nc-2.0 | cc by nc | cc by nc 2 0
cc-by-nc-3.0 | cc by nc | cc by nc 3 0
cc-by-nc-4.0 | cc by nc | cc by nc 4 0
cc-by-nc-sa-2.0 | cc by nc sa | cc by nc sa 2 0
cc-by-nc-sa-3.0 | cc by nc sa | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0
cc-by-nc-nd-3.0 | cc by nc nd | cc by nc nd 3 0
cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0
cc-by-2.0 | creativecommons org | creativecommons org licenses by 2 0
cc-by-3.0 | creativecommons org | creativecommons org licenses by 3 0
cc-by-4.0 | creativecommons org | creativecommons org licenses by 4 0
cc-by-sa-3.0 | creativecommons org | creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | creativecommons org | creativecommons org licenses by sa 4 0
cc-by-nd-4.0 | creativecommons org | creativecommons org licenses by nd 4 0
cc-by-nc-4.0 | creativecommons org | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | creativecommons org | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | creativecommons org | creativecommons org licenses by nc nd 4 0
mit | opensource org licenses | opensource org licenses mit
bsd-3-clause | opensource org licenses | opensource org licenses bsd 3 clause
wtfpl | wtfpl | wtfpl
zlib | spdx license identifier zlib | spdx license identifier zlib
unlicense | unlicense org | unlicense org
ncsa | spdx license identifier ncsa | spdx license identifier ncsa
ms-pl | ms pl | ms pl
ms-rl | ms rl | ms rl
sspl-1.0 | sspl 1 0 | sspl 1 0
busl-1.1 | busl 1 1 | busl 1 1
mulan-2.0 | mulanpsl 2 0 | mulanpsl 2 0
psf-2.0 | psf 2 0 | psf 2 0
php-3.01 | php 3 01 | php 3 01
ecl-2.0 | ecl 2 0 | ecl 2 0
upl-1.0 | upl 1 0 | upl 1 0
blueoak-1.0.0 | blueoak 1 0 0 | blueoak 1 0 0
spdx | spdx license identifier | spdx license identifier [^ ]+
"""

#: Names with a version or a variant.
VERSION = """
bsd-2-clause | simplified bsd | simplified bsd(?: ~)?
bsd-2-clause | freebsd license | freebsd ~
bsd-2-clause | two clause bsd | two clause bsd(?: ~)?
bsd-3-clause | new bsd | new bsd(?: ~)?
bsd-3-clause | modified bsd | modified bsd(?: ~)?
bsd-3-clause | three clause bsd | three clause bsd(?: ~)?
bsd-3-clause | revised bsd | revised bsd(?: ~)?
bsd-4-clause | original bsd | original bsd(?: ~)?
apache-1.0 | apache license | apache ~ (?:version |v ?)?1 0
apache-1.1 | apache license | apache ~ (?:version |v ?)?1 1
apache-2.0 | apache license | apache ~ (?:version |v ?)?2(?: 0)?
apache-2.0 | apache software license | apache software ~ (?:version |v ?)?2(?: 0)?
gpl | gplv | gplv[123]
gpl-1 | general public | general public ~ (?:version |v ?)1(?: 0)?
gpl-2 | general public | general public ~ (?:version |v ?)2(?: 0)?
gpl-3 | general public | general public ~ (?:version |v ?)3(?: 0)?
lgpl-2 | library general public | library general public ~ (?:version |v ?)2(?: 0)?
lgpl-2.1 | lesser general public | lesser general public ~ (?:version |v ?)2 1
lgpl-3 | lesser general public | lesser general public ~ (?:version |v ?)3(?: 0)?
agpl-1 | affero general public | affero general public ~ (?:version |v ?)1(?: 0)?
agpl-3 | affero general public | affero general public ~ (?:version |v ?)3(?: 0)?
gfdl-1.1 | free documentation | free documentation ~ (?:version |v ?)1 1
gfdl-1.2 | free documentation | free documentation ~ (?:version |v ?)1 2
gfdl-1.3 | free documentation | free documentation ~ (?:version |v ?)1 3
gpl-classpath-exception | classpath exception | classpath exception(?: 2 0)?
gpl-font-exception | font exception | gpl(?: [^ ]+){0,6} font exception
mpl-1.0 | mozilla public | mozilla public ~ (?:version |v ?)1 0
mpl-1.1 | mozilla public | mozilla public ~ (?:version |v ?)1 1
mpl-2.0 | mozilla public | mozilla public ~ (?:version |v ?)2 0
epl-1.0 | eclipse public | eclipse public ~ (?:version |v ?)1 0
epl-2.0 | eclipse public | eclipse public ~ (?:version |v ?)2 0
cddl-1.0 | common development and distribution | common development and distribution ~ (?:version |v ?)1 0
cddl-1.1 | common development and distribution | common development and distribution ~ (?:version |v ?)1 1
cpl-1.0 | common public | common public ~ (?:version |v ?)1 0
eupl-1.1 | european union public | european union public ~ (?:version |v ?)1 1
eupl-1.2 | european union public | european union public ~ (?:version |v ?)1 2
osl-3.0 | open software license | open software ~ (?:version |v ?)3 0
afl-3.0 | academic free license | academic free ~ (?:version |v ?)3 0
artistic-1.0 | artistic license | artistic ~ (?:version |v ?)?1 0
artistic-2.0 | artistic license | artistic ~ (?:version |v ?)?2 0
boost-1.0 | boost software license | boost software ~ (?:version |v ?)1 0
ofl-1.1 | sil open font | sil open font ~ (?:version |v ?)?1 1
odbl-1.0 | open database license | open database ~ (?:version |v ?)?1 0
elastic-2.0 | elastic license | elastic ~ (?:version |v ?)?2(?: 0)?
busl-1.1 | business source license | business source ~ (?:version |v ?)?1 1
mulan-2.0 | mulan | mulan permissive software ~ (?:version |v ?)?2
php-3.01 | php license | php ~ (?:version |v ?)3 01
cc-by-2.0 | creative commons attribution | creative commons attribution 2 0
cc-by-2.5 | creative commons attribution | creative commons attribution 2 5
cc-by-3.0 | creative commons attribution | creative commons attribution 3 0
cc-by-4.0 | creative commons attribution | creative commons attribution 4 0
cc-by-sa-2.0 | creative commons attribution | creative commons attribution sharealike 2 0
cc-by-sa-2.5 | creative commons attribution | creative commons attribution sharealike 2 5
cc-by-sa-3.0 | creative commons attribution | creative commons attribution sharealike 3 0
cc-by-sa-4.0 | creative commons attribution | creative commons attribution share ?alike 4 0
cc-by-nd-3.0 | creative commons attribution | creative commons attribution noderiv(?:ative)?s 3 0
cc-by-nd-4.0 | creative commons attribution | creative commons attribution noderiv(?:ative)?s 4 0
cc-by-nc-3.0 | creative commons attribution | creative commons attribution non ?commercial 3 0
cc-by-nc-4.0 | creative commons attribution | creative commons attribution non ?commercial 4 0
cc-by-nc-sa-4.0 | creative commons attribution | creative commons attribution non ?commercial share ?alike 4 0
cc-by-nc-nd-4.0 | creative commons attribution | creative commons attribution non ?commercial noderiv(?:ative)?s 4 0
"""

#: Names alone.
NAME = """
x11 | x11 license | x11 ~
isc | isc license | isc ~
bsd | bsd license | (?:the )?bsd ~
bsd | bsd style | bsd style ~
mit | expat license | expat ~
mit | mit style | mit style ~
apache | apache software license | apache software ~
gpl | gnu gpl | (?:the )?gnu gpl
lgpl | gnu lgpl | (?:the )?gnu lgpl
agpl | gnu agpl | (?:the )?gnu agpl
lgpl | lesser general public | (?:gnu )?lesser general public ~
lgpl | library general public | (?:gnu )?library general public ~
agpl | affero general public | (?:gnu )?affero general public ~
gfdl | free documentation license | (?:gnu )?free documentation ~
mpl | mozilla public license | mozilla public ~
epl | eclipse public license | eclipse public ~
edl | eclipse distribution license | eclipse distribution ~
cddl | common development and distribution | common development and distribution ~
cpl | common public license | common public ~
ipl | ibm public license | ibm public ~
eupl | european union public | european union public ~
osl | open software license | open software ~
afl | academic free license | academic free ~
artistic | artistic license | artistic ~
zlib | zlib license | zlib ~
libpng | libpng license | libpng ~
boost | boost software license | boost software ~
unlicense | unlicense | (?:the )?unlicense
psf | python software foundation | python software foundation ~
php | php license | (?:the )?php ~
ruby | ruby license | ruby ~
vim | vim license | vim ~
openssl | openssl license | openssl ~
postgresql | postgresql license | postgresql ~
ncsa | university of illinois | university of illinois ncsa open source ~
ofl | sil open font | sil open font ~
odbl | open database license | open database ~
odc-by | open data commons attribution | open data commons attribution ~
pddl | public domain dedication and license | public domain dedication and ~
sspl | server side public license | server side public ~
busl | business source license | business source ~
elastic | elastic license | elastic ~
commons-clause | commons clause | commons clause
mulan | mulan | mulan (?:psl|permissive software ~)
ms-pl | microsoft public license | microsoft public ~
ms-rl | microsoft reciprocal license | microsoft reciprocal ~
upl | universal permissive license | universal permissive ~
ecl | educational community license | educational community ~
cecill | cecill | cecill(?: [abc])?
beerware | beerware | beerware(?: ~)?
jsl | json license | json ~
cc | creative commons | creative commons(?: ~)?
cc-by-sa | attribution sharealike | attribution sharealike
public-domain | public domain | (?:in|into|to) the public domain
"""

#: What hints at a licence without naming one.
HINT = """
mit-style-disclaimer | the software is provided as is | the software is provided as is without warranty of any kind express or implied
bsd-style-disclaimer | this software is provided by | this software is provided by [^ ]+(?: [^ ]+){0,8} as is
gpl-linking-exception | special exception | as a special exception(?: [^ ]+){1,20} permission to link
all-rights-reserved | all rights reserved | all rights reserved
some-rights-reserved | some rights reserved | some rights reserved
copyright | copyright | copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright | copr | copr (?:19|20)[0-9]{2}
proprietary | confidential and proprietary | confidential and proprietary
proprietary | proprietary license | proprietary ~
proprietary | trade secret | contains? trade secrets?
evaluation | evaluation license | evaluation ~
non-commercial | non commercial use only | (?:for )?non commercial use only
non-commercial | personal use only | (?:for )?personal use only
freeware | freeware | freeware
shareware | shareware | shareware
see-license | see the license | see the ~(?: file)? for (?:details|more information)
see-license | license file | (?:found )?in the ~ file
"""
