"""Signature rules for licences, in order of priority.

A line is `label; weight; keyword; pattern`. Patterns are matched against a text's words in lower case with one
space between them (marks part words: "GPL-2.0+" is "gpl 2 0"); they begin and end at words. A rule is tried
only on texts that hold its keyword. Of rules with the same words the earlier one counts.
"""

from __future__ import annotations

#: Phrases whose places are counted as they are; their labels always stay.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

RULES = r"""
apache-1.0; 1.00; spdx; spdx license identifier apache 1 0
apache-1.1; 1.00; spdx; spdx license identifier apache 1 1
apache-2; 1.00; spdx; spdx license identifier apache 2 0
agpl-1.0; 1.00; spdx; spdx license identifier agpl 1 0(?: only| or later)?
agpl-3.0-only; 1.00; spdx; spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later; 1.00; spdx; spdx license identifier agpl 3 0 or later
afl-3.0; 1.00; spdx; spdx license identifier afl 3 0
artistic-1.0; 1.00; spdx; spdx license identifier artistic 1 0(?: perl| cl8)?
artistic-2.0; 1.00; spdx; spdx license identifier artistic 2 0
bsl-1.0; 1.00; spdx; spdx license identifier bsl 1 0
0bsd; 1.00; spdx; spdx license identifier 0bsd
bsd-1-clause; 1.00; spdx; spdx license identifier bsd 1 clause
bsd-2-clause; 1.00; spdx; spdx license identifier bsd 2 clause(?: patent| views)?
bsd-3-clause; 1.00; spdx; spdx license identifier bsd 3 clause(?: clear| lbnl| attribution)?
bsd-4-clause; 1.00; spdx; spdx license identifier bsd 4 clause(?: uc)?
busl-1.1; 1.00; spdx; spdx license identifier busl 1 1
cc0-1.0; 1.00; spdx; spdx license identifier cc0 1 0
cc-by-3.0; 1.00; spdx; spdx license identifier cc by 3 0
cc-by-4.0; 1.00; spdx; spdx license identifier cc by 4 0
cc-by-sa-3.0; 1.00; spdx; spdx license identifier cc by sa 3 0
cc-by-sa-4.0; 1.00; spdx; spdx license identifier cc by sa 4 0
cc-by-nc-4.0; 1.00; spdx; spdx license identifier cc by nc 4 0
cc-by-nd-4.0; 1.00; spdx; spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0; 1.00; spdx; spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0; 1.00; spdx; spdx license identifier cc by nc nd 4 0
cddl-1.0; 1.00; spdx; spdx license identifier cddl 1 0
cddl-1.1; 1.00; spdx; spdx license identifier cddl 1 1
cecill-2.1; 1.00; spdx; spdx license identifier cecill 2 1
cpl-1.0; 1.00; spdx; spdx license identifier cpl 1 0
ecl-2.0; 1.00; spdx; spdx license identifier ecl 2 0
epl-1.0; 1.00; spdx; spdx license identifier epl 1 0
epl-2.0; 1.00; spdx; spdx license identifier epl 2 0
eupl-1.1; 1.00; spdx; spdx license identifier eupl 1 1
eupl-1.2; 1.00; spdx; spdx license identifier eupl 1 2
gfdl-1.3; 1.00; spdx; spdx license identifier gfdl 1 3(?: only| or later)?
gpl-1.0; 1.00; spdx; spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0-only; 1.00; spdx; spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later; 1.00; spdx; spdx license identifier gpl 2 0 or later
gpl-3.0-only; 1.00; spdx; spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later; 1.00; spdx; spdx license identifier gpl 3 0 or later
isc; 1.00; spdx; spdx license identifier isc
lgpl-2.0; 1.00; spdx; spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1-only; 1.00; spdx; spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later; 1.00; spdx; spdx license identifier lgpl 2 1 or later
lgpl-3.0-only; 1.00; spdx; spdx license identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later; 1.00; spdx; spdx license identifier lgpl 3 0 or later
lppl-1.3c; 1.00; spdx; spdx license identifier lppl 1 3c
mit; 1.00; spdx; spdx license identifier mit
mit-0; 1.00; spdx; spdx license identifier mit 0
mpl-1.1; 1.00; spdx; spdx license identifier mpl 1 1
mpl-2.0; 1.00; spdx; spdx license identifier mpl 2 0
ms-pl; 1.00; spdx; spdx license identifier ms pl
ms-rl; 1.00; spdx; spdx license identifier ms rl
ncsa; 1.00; spdx; spdx license identifier ncsa
odbl-1.0; 1.00; spdx; spdx license identifier odbl 1 0
ofl-1.1; 1.00; spdx; spdx license identifier ofl 1 1
openssl; 1.00; spdx; spdx license identifier openssl
osl-3.0; 1.00; spdx; spdx license identifier osl 3 0
php-3.01; 1.00; spdx; spdx license identifier php 3 01
postgresql; 1.00; spdx; spdx license identifier postgresql
python-2.0; 1.00; spdx; spdx license identifier (?:python|psf) 2 0
ruby; 1.00; spdx; spdx license identifier ruby
sspl-1.0; 1.00; spdx; spdx license identifier sspl 1 0
unlicense; 1.00; spdx; spdx license identifier unlicense
upl-1.0; 1.00; spdx; spdx license identifier upl 1 0
vim; 1.00; spdx; spdx license identifier vim
w3c; 1.00; spdx; spdx license identifier w3c(?: 20150513)?
wtfpl; 1.00; spdx; spdx license identifier wtfpl
x11; 1.00; spdx; spdx license identifier x11
zlib; 1.00; spdx; spdx license identifier zlib
zpl-2.1; 1.00; spdx; spdx license identifier zpl 2 1
mit; 0.99; license; (?:licensed|released|distributed|available|published) under the(?: terms of the)? mit license
mit; 0.99; permission; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit; 0.95; opensource; opensource org licenses? mit(?: license php)?
mit; 0.95; license; (?:the )?mit license mit
mit-0; 0.95; attribution; mit no attribution(?: license)?
mit; 0.90; license; (?:the )?(?:mit|expat) licen[sc]e
mit; 0.80; licensed; (?:mit|expat) licensed
x11; 0.90; x11; (?:the )?x11 licen[sc]e
apache-2; 0.99; apache; licensed under the apache licen[sc]e version 2 0(?: the license)?
apache-2; 0.99; apache; (?:licensed|released|distributed|available|published) under(?: the terms of)?(?: the)? apache(?: software)?(?: license)?(?: version)?(?: v2| 2)(?: 0)?
apache-2; 0.95; apache; (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2; 0.95; opensource; opensource org licenses? apache 2 0
apache-1.1; 0.95; apache; (?:the )?apache software license version 1 1
apache-1.0; 0.95; apache; (?:the )?apache (?:software )?license version 1 0
apache-1.1; 0.95; apache; (?:www )?apache org licenses license 1 1
apache-2; 0.90; apache; (?:the )?apache(?: software)? licen[sc]e(?: version)?(?: v2| 2)(?: 0)?
apache-2; 0.90; apache; apache v?2(?: 0)?(?: license)?
apache; 0.60; apache; (?:the )?apache(?: software)? licen[sc]e
gpl-2.0-or-later; 0.99; gnu; gnu general public license as published by the free software foundation either version 2(?: of the license)? or(?: at your option)? any later version
gpl-3.0-or-later; 0.99; gnu; gnu general public license as published by the free software foundation either version 3(?: of the license)? or(?: at your option)? any later version
lgpl-2.1-or-later; 0.99; lesser; gnu lesser general public license as published by the free software foundation either version 2 1(?: of the license)? or(?: at your option)? any later version
lgpl-3.0-or-later; 0.99; lesser; gnu lesser general public license as published by the free software foundation either version 3(?: of the license)? or(?: at your option)? any later version
lgpl-2.0-or-later; 0.99; library; gnu library general public license as published by the free software foundation either version 2(?: of the license)? or(?: at your option)? any later version
agpl-3.0-or-later; 0.99; affero; gnu affero general public license as published by the free software foundation either version 3(?: of the license)? or(?: at your option)? any later version
gpl-2.0-only; 0.98; gnu; gnu general public license version 2 as published by the free software foundation
gpl-3.0-only; 0.98; gnu; gnu general public license version 3 as published by the free software foundation
agpl-3.0; 0.95; affero; (?:licensed under )?(?:the )?gnu affero general public license(?: as published by the free software foundation)?(?: version| v)? ?3(?: 0)?
lgpl-2.1; 0.95; lesser; (?:licensed under )?(?:the )?gnu lesser general public license(?: version| v)? ?2 1
lgpl-3.0; 0.95; lesser; (?:licensed under )?(?:the )?gnu lesser general public license(?: version| v)? ?3(?: 0)?
lgpl-2.0; 0.95; library; (?:licensed under )?(?:the )?gnu library general public license(?: version| v)? ?2(?: 0)?
gpl-1.0; 0.95; gnu; (?:licensed under )?(?:the )?gnu general public license(?: version| v)? ?1(?: 0)?
gpl-2.0; 0.95; gnu; (?:licensed under )?(?:the )?gnu general public license(?: version| v)? ?2(?: 0)?
gpl-3.0; 0.95; gnu; (?:licensed under )?(?:the )?gnu general public license(?: version| v)? ?3(?: 0)?
gpl-2.0-or-later; 0.95; gnu; (?:the )?gnu general public license(?: version| v)? ?2(?: 0)? or(?: any)? later
gpl-3.0-or-later; 0.95; gnu; (?:the )?gnu general public license(?: version| v)? ?3(?: 0)? or(?: any)? later
gfdl-1.1; 0.95; gnu; (?:the )?gnu free documentation license version 1 1
gfdl-1.2; 0.95; gnu; (?:the )?gnu free documentation license version 1 2
gfdl-1.3; 0.95; gnu; (?:the )?gnu free documentation license version 1 3
gpl-2.0; 0.95; gnu; (?:www )?gnu org (?:licenses )?(?:old licenses )?gpl 2 0(?: html| txt)?
gpl-3.0; 0.95; gnu; (?:www )?gnu org (?:licenses )?gpl 3 0(?: html| txt)?
lgpl-2.1; 0.95; gnu; (?:www )?gnu org (?:licenses )?(?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-3.0; 0.95; gnu; (?:www )?gnu org (?:licenses )?lgpl 3 0(?: html| txt)?
agpl-3.0; 0.95; gnu; (?:www )?gnu org (?:licenses )?agpl 3 0(?: html| txt)?
gfdl-1.3; 0.90; gnu; (?:www )?gnu org (?:licenses )?fdl 1 3(?: html| txt)?
gpl-2.0; 0.85; gpl; (?:gnu )?gpl(?: version)?(?: v2| 2)(?: 0)?
gpl-2.0; 0.85; gplv2; (?:gnu )?gplv2
gpl-3.0; 0.85; gpl; (?:gnu )?gpl(?: version)?(?: v3| 3)(?: 0)?
gpl-3.0; 0.85; gplv3; (?:gnu )?gplv3
lgpl-2.1; 0.85; lgpl; (?:gnu )?lgpl(?: version)?(?: v2| 2) 1
lgpl-2.1; 0.85; lgplv2; (?:gnu )?lgplv2 1
lgpl-3.0; 0.85; lgpl; (?:gnu )?lgpl(?: version)?(?: v3| 3)(?: 0)?
lgpl-3.0; 0.85; lgplv3; (?:gnu )?lgplv3
agpl-3.0; 0.85; agpl; (?:gnu )?agpl(?: version)?(?: v3| 3)(?: 0)?
agpl-3.0; 0.85; agplv3; (?:gnu )?agplv3
agpl; 0.70; affero; (?:the )?(?:gnu )?affero general public licen[sc]e
lgpl; 0.70; lesser; (?:the )?(?:gnu )?lesser general public licen[sc]e
lgpl; 0.70; library; (?:the )?(?:gnu )?library general public licen[sc]e
gpl; 0.70; general; (?:the )?(?:gnu )?general public licen[sc]e
gfdl; 0.70; gnu; (?:the )?gnu free documentation licen[sc]e
gpl; 0.60; gpl; (?:licensed|released|distributed) under(?: the)?(?: gnu)? gpl
lgpl; 0.60; lgpl; (?:licensed|released|distributed) under(?: the)?(?: gnu)? lgpl
gpl-classpath-exception; 0.95; classpath; (?:with )?(?:the )?classpath exception
gpl-gcc-exception; 0.95; gcc; (?:with )?(?:the )?gcc runtime library exception
bsd-2-clause; 0.99; redistributions; redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided
bsd-3-clause; 0.99; endorse; neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-4-clause; 0.99; advertising; all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd; 0.90; redistribution; redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause; 0.95; bsd; (?:the )?(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: license)?
bsd-3-clause; 0.95; bsd; (?:the )?(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|revised bsd|modified bsd)(?: license)?
bsd-4-clause; 0.95; bsd; (?:the )?(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: license)?
0bsd; 0.95; bsd; (?:the )?(?:zero clause bsd|bsd zero clause|bsd 0 clause|0 clause bsd)(?: license)?
bsd-2-clause; 0.95; opensource; opensource org licenses? bsd 2 clause
bsd-3-clause; 0.95; opensource; opensource org licenses? bsd 3 clause
bsd; 0.90; bsd; (?:licensed|released|distributed|available) under(?: the terms of)?(?: the| a)? bsd(?: style)? licen[sc]e
bsd; 0.60; bsd; (?:the )?bsd(?: style)? licen[sc]e
isc; 0.95; permission; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd; 0.90; permission; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
isc; 0.95; opensource; opensource org licenses? isc(?: license txt)?
isc; 0.90; isc; (?:the )?isc licen[sc]e
mpl-2.0; 0.99; mozilla; this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?2 0
mpl-1.1; 0.99; mozilla; the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0; 0.95; mozilla; (?:the )?mozilla public license(?: version| v)? ?1 0
mpl-1.1; 0.95; mozilla; (?:the )?mozilla public license(?: version| v)? ?1 1
mpl-2.0; 0.95; mozilla; (?:the )?mozilla public license(?: version)?(?: v2| 2)(?: 0)?
mpl-2.0; 0.95; mozilla; (?:www )?mozilla org (?:en us )?mpl 2 0
mpl-1.1; 0.90; mozilla; (?:www )?mozilla org mpl mpl 1 1(?: html)?
mpl; 0.70; mozilla; (?:the )?mozilla public licen[sc]e
epl-1.0; 0.95; eclipse; (?:the )?eclipse public license(?: version| v)? ?1 0
epl-2.0; 0.95; eclipse; (?:the )?eclipse public license(?: version)?(?: v2| 2)(?: 0)?
epl-1.0; 0.95; eclipse; (?:www )?eclipse org legal epl v10(?: html)?
epl-2.0; 0.95; eclipse; (?:www )?eclipse org legal epl (?:2 0|v20)(?: html)?
edl-1.0; 0.95; eclipse; (?:the )?eclipse distribution license(?: version| v)? ?1 0
epl; 0.70; eclipse; (?:the )?eclipse public licen[sc]e
cpl-1.0; 0.95; common; (?:the )?common public license(?: version| v)? ?1 0
ipl-1.0; 0.95; ibm; (?:the )?ibm public license(?: version| v)? ?1 0
cddl-1.0; 0.95; distribution; (?:the )?common development and distribution license(?: cddl)?(?: version| v)? ?1 0
cddl-1.1; 0.95; distribution; (?:the )?common development and distribution license(?: cddl)?(?: version| v)? ?1 1
cddl; 0.70; distribution; (?:the )?common development and distribution licen[sc]e
cc0-1.0; 0.99; cc0; (?:licensed|released|published|available|dedicated) (?:under|to)(?: the)?(?: creative commons)? cc0(?: 1 0)?(?: universal)?
cc0-1.0; 0.95; creative; creative commons (?:cc0|zero)(?: v?1 0)?(?: universal)?
cc0-1.0; 0.95; cc0; cc0 1 0(?: universal)?
cc0-1.0; 0.95; creativecommons; creativecommons org publicdomain zero 1 0
cc-pdm; 0.90; creativecommons; creativecommons org publicdomain mark 1 0
cc-by-1.0; 0.95; creativecommons; creativecommons org licenses by 1 0
cc-by-2.0; 0.95; creativecommons; creativecommons org licenses by 2 0
cc-by-2.5; 0.95; creativecommons; creativecommons org licenses by 2 5
cc-by-3.0; 0.95; creativecommons; creativecommons org licenses by 3 0
cc-by-4.0; 0.95; creativecommons; creativecommons org licenses by 4 0
cc-by-sa-2.0; 0.95; creativecommons; creativecommons org licenses by sa 2 0
cc-by-sa-2.5; 0.95; creativecommons; creativecommons org licenses by sa 2 5
cc-by-sa-3.0; 0.95; creativecommons; creativecommons org licenses by sa 3 0
cc-by-sa-4.0; 0.95; creativecommons; creativecommons org licenses by sa 4 0
cc-by-nc-2.0; 0.95; creativecommons; creativecommons org licenses by nc 2 0
cc-by-nc-3.0; 0.95; creativecommons; creativecommons org licenses by nc 3 0
cc-by-nc-4.0; 0.95; creativecommons; creativecommons org licenses by nc 4 0
cc-by-nd-3.0; 0.95; creativecommons; creativecommons org licenses by nd 3 0
cc-by-nd-4.0; 0.95; creativecommons; creativecommons org licenses by nd 4 0
cc-by-nc-sa-3.0; 0.95; creativecommons; creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0; 0.95; creativecommons; creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-3.0; 0.95; creativecommons; creativecommons org licenses by nc nd 3 0
cc-by-nc-nd-4.0; 0.95; creativecommons; creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-4.0; 0.95; creative; creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)? 4 0(?: international)?
cc-by-nc-sa-4.0; 0.95; creative; creative commons attribution non ?commercial share ?alike 4 0(?: international)?
cc-by-nc-nd-3.0; 0.95; creative; creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)? 3 0(?: unported)?
cc-by-nc-sa-3.0; 0.95; creative; creative commons attribution non ?commercial share ?alike 3 0(?: unported)?
cc-by-nc-4.0; 0.95; creative; creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nc-3.0; 0.95; creative; creative commons attribution non ?commercial 3 0(?: unported)?
cc-by-nd-4.0; 0.95; creative; creative commons attribution no ?deriv(?:ative)?s(?: works)? 4 0(?: international)?
cc-by-nd-3.0; 0.95; creative; creative commons attribution no ?deriv(?:ative)?s(?: works)? 3 0(?: unported)?
cc-by-sa-4.0; 0.95; creative; creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-3.0; 0.95; creative; creative commons attribution share ?alike 3 0(?: unported)?
cc-by-sa-2.5; 0.95; creative; creative commons attribution share ?alike 2 5(?: generic)?
cc-by-4.0; 0.95; creative; creative commons attribution 4 0(?: international)?
cc-by-3.0; 0.95; creative; creative commons attribution 3 0(?: unported)?
cc-by-2.0; 0.95; creative; creative commons attribution 2 0(?: generic)?
cc-by-nc-nd-4.0; 0.90; cc; cc by nc nd 4 0(?: international)?
cc-by-nc-sa-4.0; 0.90; cc; cc by nc sa 4 0(?: international)?
cc-by-nc-nd-3.0; 0.90; cc; cc by nc nd 3 0
cc-by-nc-sa-3.0; 0.90; cc; cc by nc sa 3 0
cc-by-nc-4.0; 0.90; cc; (?:licensed under )?cc by nc 4 0(?: international)?
cc-by-nc-3.0; 0.90; cc; (?:licensed under )?cc by nc 3 0
cc-by-nd-4.0; 0.90; cc; cc by nd 4 0(?: international)?
cc-by-sa-4.0; 0.90; cc; (?:licensed under )?cc by sa 4 0(?: international)?
cc-by-sa-3.0; 0.90; cc; (?:licensed under )?cc by sa 3 0
cc-by-4.0; 0.90; cc; (?:licensed under )?cc by 4 0(?: international)?
cc-by-3.0; 0.90; cc; (?:licensed under )?cc by 3 0
cc-by-nc-nd; 0.75; cc; cc by nc nd
cc-by-nc-sa; 0.75; cc; cc by nc sa
cc-by-nd; 0.75; cc; cc by nd
cc-by-sa; 0.75; cc; cc by sa
creative-commons; 0.60; creative; (?:licensed|released|published|available) under(?: a| the)? creative commons(?: attribution)?(?: license)?
unlicense; 0.99; unencumbered; this is free and unencumbered software released into the public domain
unlicense; 0.95; unlicense; (?:the )?unlicense(?: org)?
public-domain; 0.80; domain; (?:is |are |been )?(?:hereby )?(?:in|into|to|placed in|released into|dedicated to) the public domain
wtfpl; 0.95; wtfpl; (?:the )?wtfpl(?: version 2| v2)?
wtfpl; 0.95; want; do what the fuck you want to public licen[sc]e(?: version 2)?
zlib; 0.95; misrepresented; the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib; 0.90; zlib; (?:the )?zlib(?: libpng)? licen[sc]e
libpng; 0.90; libpng; (?:the )?libpng licen[sc]e(?: version 2)?
bsl-1.0; 0.95; boost; (?:distributed under )?(?:the )?boost software license(?: version)?(?: 1 0)?
bsl-1.0; 0.95; boost; (?:www )?boost org license 1 0(?: txt)?
busl-1.1; 0.95; business; (?:the )?business source license(?: version)?(?: 1 1)?
sspl-1.0; 0.95; server; (?:the )?server side public license(?: version| v)?(?: ?1)?
elastic-2.0; 0.95; elastic; (?:the )?elastic license(?: version)?(?: v2| 2)(?: 0)?
artistic-2.0; 0.95; artistic; (?:the )?artistic license(?: version)?(?: v2| 2)(?: 0)?
artistic-1.0; 0.95; artistic; (?:the )?artistic license(?: version)?(?: v1| 1)(?: 0)?
artistic; 0.70; artistic; (?:the )?artistic licen[sc]e
perl; 0.90; perl; (?:under )?the same terms as perl(?: itself)?
afl-3.0; 0.95; academic; (?:the )?academic free license(?: version| v)?(?: ?3(?: 0)?)?
osl-3.0; 0.95; open; (?:the )?open software license(?: version| v)?(?: ?3(?: 0)?)?
ecl-2.0; 0.95; educational; (?:the )?educational community license(?: version)?(?: 2 0)?
eupl-1.2; 0.95; european; (?:the )?european union public licen[sc]e(?: version| v)? ?1 2
eupl-1.1; 0.95; european; (?:the )?european union public licen[sc]e(?: version| v)? ?1 1
eupl; 0.70; european; (?:the )?european union public licen[sc]e
cecill-2.1; 0.95; cecill; (?:the )?cecill(?: free software)?(?: license)?(?: agreement)? 2 1
cecill-b; 0.95; cecill; (?:the )?cecill b(?: license)?
cecill-c; 0.95; cecill; (?:the )?cecill c(?: license)?
cecill; 0.80; cecill; (?:the )?cecill(?: license)?
lppl-1.3c; 0.95; latex; (?:the )?latex project public license(?: version)?(?: 1 3c?)?
ms-pl; 0.95; microsoft; (?:the )?microsoft public licen[sc]e(?: ms pl)?
ms-rl; 0.95; microsoft; (?:the )?microsoft reciprocal licen[sc]e(?: ms rl)?
ncsa; 0.95; illinois; (?:the )?university of illinois(?: ncsa)? open source licen[sc]e
ofl-1.1; 0.95; sil; (?:licensed under )?(?:the )?sil open font license(?: version)?(?: 1 1)?
ofl-1.0; 0.95; sil; (?:the )?sil open font license(?: version)? 1 0
odbl-1.0; 0.95; database; (?:the )?open (?:data commons open )?database license(?: odbl)?(?: v?1 0)?
odc-by-1.0; 0.95; commons; (?:the )?open data commons attribution license(?: odc by)?(?: v?1 0)?
pddl-1.0; 0.95; dedication; (?:the )?(?:open data commons )?public domain dedication and license(?: pddl)?(?: v?1 0)?
openssl; 0.95; openssl; (?:the )?openssl licen[sc]e
openssl; 0.95; openssl; this product includes software developed by the openssl project
php-3.01; 0.95; php; (?:the )?php license(?: version)? 3 01
php-3.0; 0.95; php; (?:the )?php license(?: version)? 3 0
postgresql; 0.95; postgresql; (?:the )?postgresql licen[sc]e
psf-2.0; 0.95; python; (?:the )?python software foundation license(?: version)?(?: 2)?
ruby; 0.90; ruby; (?:the )?ruby licen[sc]e
qpl-1.0; 0.95; public; (?:the )?q public license(?: version)?(?: 1 0)?
sleepycat; 0.95; sleepycat; (?:the )?sleepycat licen[sc]e
tcl; 0.90; tcl; (?:the )?tcl(?: tk)? licen[sc]e
upl-1.0; 0.95; universal; (?:the )?universal permissive license(?: version| v)?(?: ?1 0)?
vim; 0.95; vim; (?:the )?vim licen[sc]e
w3c; 0.95; w3c; (?:the )?w3c software(?: and document)?(?: notice and)? licen[sc]e
wxwindows; 0.95; wxwindows; (?:the )?wxwindows library licen[sc]e(?: version 3(?: 1)?)?
zpl-2.1; 0.95; zope; (?:the )?zope public license(?: version)? 2 1
zpl; 0.80; zope; (?:the )?zope public licen[sc]e
json; 0.95; evil; the software shall be used for good not evil
beerware; 0.95; beer; (?:the )?beer ?ware licen[sc]e
rpl-1.5; 0.95; reciprocal; (?:the )?reciprocal public license(?: version)?(?: 1 5)?
sgi-b-2.0; 0.95; sgi; (?:the )?sgi free software license b(?: version)?(?: 2 0)?
nposl-3.0; 0.95; profit; (?:the )?non profit open software license(?: version)?(?: 3 0)?
openrail-m; 0.95; rail; (?:the )?(?:creativeml |bigscience )?open rail m(?: license)?
bigscience-rail-1.0; 0.95; rail; (?:the )?bigscience rail license(?: v1 0)?
llama-2; 0.95; llama; (?:the )?llama 2 community license(?: agreement)?
llama-3; 0.95; llama; (?:the )?(?:meta )?llama 3 community license(?: agreement)?
all-rights-reserved; 0.80; reserved; (?:copyright .{1,60}? )?all rights reserved
proprietary; 0.80; proprietary; (?:this )?(?:software |document |material )?is(?: confidential and)? proprietary
proprietary; 0.80; unauthorized; unauthorized (?:copying|use|reproduction|distribution) .{0,60}?is(?: strictly)? prohibited
non-commercial; 0.70; commercial; for non ?commercial (?:use|purposes|research)(?: only)?
""".strip().splitlines()
