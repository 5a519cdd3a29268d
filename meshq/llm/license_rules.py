"""The license scan's signature rules, in order: of two detections that overlap in part, and of two in one place, that of the earlier rule
stays.

A line holds label, weight, keyword and expression, which is sought in lower-case text; every match holds the keyword, and the words
behind a plus sign. A blank stands for any white space with the comment marks of the lines that follow.
"""

from __future__ import annotations

# What a blank of an expression stands for: white space, with the comment marks of the lines that follow.
GAP = r"[\x09-\x0d\x20\xa0]++(?:[*#/;%>|!-]++[\x09-\x0d\x20\xa0]++)*+"

LINES = r"""
# Identifiers that a file states
agpl-3.0-or-later 1.0 spdx spdx-license-identifier: ?agpl-3\.0-or-later
agpl-3.0 1.0 spdx spdx-license-identifier: ?agpl-3\.0(?:-only)?
lgpl-3.0-or-later 1.0 spdx spdx-license-identifier: ?lgpl-3\.0-or-later
lgpl-3.0 1.0 spdx spdx-license-identifier: ?lgpl-3\.0(?:-only)?
lgpl-2.1-or-later 1.0 spdx spdx-license-identifier: ?lgpl-2\.1(?:-or-later|\+)
lgpl-2.1 1.0 spdx spdx-license-identifier: ?lgpl-2\.1(?:-only)?
lgpl-2.0 1.0 spdx spdx-license-identifier: ?lgpl-2\.0(?:-only|-or-later|\+)?
gpl-3.0-or-later 1.0 spdx spdx-license-identifier: ?gpl-3\.0(?:-or-later|\+)
gpl-3.0 1.0 spdx spdx-license-identifier: ?gpl-3\.0(?:-only)?
gpl-2.0-or-later 1.0 spdx spdx-license-identifier: ?gpl-2\.0(?:-or-later|\+)
gpl-2.0 1.0 spdx spdx-license-identifier: ?gpl-2\.0(?:-only)?(?: with [a-z0-9.-]+)?
gpl-1.0 1.0 spdx spdx-license-identifier: ?gpl-1\.0(?:-only|-or-later|\+)?
apache-2.0 1.0 spdx spdx-license-identifier: ?apache-2\.0
apache-1.1 1.0 spdx spdx-license-identifier: ?apache-1\.1
mit-0 1.0 spdx spdx-license-identifier: ?mit-0
mit 1.0 spdx spdx-license-identifier: ?mit(?![\w.-])
bsd-2-clause 1.0 spdx spdx-license-identifier: ?bsd-2-clause(?:-patent|-views)?
bsd-3-clause-clear 1.0 spdx spdx-license-identifier: ?bsd-3-clause-clear
bsd-3-clause 1.0 spdx spdx-license-identifier: ?bsd-3-clause
bsd-4-clause 1.0 spdx spdx-license-identifier: ?bsd-4-clause(?:-uc)?
bsd-0-clause 1.0 spdx spdx-license-identifier: ?0bsd
isc 1.0 spdx spdx-license-identifier: ?isc(?![\w.-])
mpl-2.0 1.0 spdx spdx-license-identifier: ?mpl-2\.0(?:-no-copyleft-exception)?
mpl-1.1 1.0 spdx spdx-license-identifier: ?mpl-1\.1
epl-2.0 1.0 spdx spdx-license-identifier: ?epl-2\.0
epl-1.0 1.0 spdx spdx-license-identifier: ?epl-1\.0
eupl-1.2 1.0 spdx spdx-license-identifier: ?eupl-1\.2
cddl-1.0 1.0 spdx spdx-license-identifier: ?cddl-1\.[01]
boost-1.0 1.0 spdx spdx-license-identifier: ?bsl-1\.0
busl-1.1 1.0 spdx spdx-license-identifier: ?busl-1\.1
zlib 1.0 spdx spdx-license-identifier: ?zlib(?![\w.-])
unlicense 1.0 spdx spdx-license-identifier: ?unlicense
wtfpl 1.0 spdx spdx-license-identifier: ?wtfpl
cc0-1.0 1.0 spdx spdx-license-identifier: ?cc0-1\.0
cc-by-4.0 1.0 spdx spdx-license-identifier: ?cc-by-4\.0
cc-by-sa-4.0 1.0 spdx spdx-license-identifier: ?cc-by-sa-4\.0
cc-by-nc-4.0 1.0 spdx spdx-license-identifier: ?cc-by-nc-4\.0
ofl-1.1 1.0 spdx spdx-license-identifier: ?ofl-1\.1
artistic-2.0 1.0 spdx spdx-license-identifier: ?artistic-2\.0
python-2.0 1.0 spdx spdx-license-identifier: ?(?:python-2\.0|psf-2\.0)
ms-pl 1.0 spdx spdx-license-identifier: ?ms-pl
spdx-other 0.6 spdx spdx-license-identifier: ?[a-z0-9][a-z0-9.+-]*
# Creative Commons, by address
cc-by-nc-nd-4.0 0.99 creativecommons.org creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nc-sa-4.0 0.99 creativecommons.org creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-4.0 0.99 creativecommons.org creativecommons\.org/licenses/by-nc/4\.0
cc-by-nd-4.0 0.99 creativecommons.org creativecommons\.org/licenses/by-nd/4\.0
cc-by-sa-4.0 0.99 creativecommons.org creativecommons\.org/licenses/by-sa/4\.0
cc-by-4.0 0.99 creativecommons.org creativecommons\.org/licenses/by/4\.0
cc-by-nc-nd-3.0 0.99 creativecommons.org creativecommons\.org/licenses/by-nc-nd/3\.0
cc-by-nc-sa-3.0 0.99 creativecommons.org creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-3.0 0.99 creativecommons.org creativecommons\.org/licenses/by-nc/3\.0
cc-by-sa-3.0 0.99 creativecommons.org creativecommons\.org/licenses/by-sa/3\.0
cc-by-3.0 0.99 creativecommons.org creativecommons\.org/licenses/by/3\.0
cc-by-nc-nd 0.97 creativecommons.org creativecommons\.org/licenses/by-nc-nd(?:/[\d.]+)?
cc-by-nc-sa 0.97 creativecommons.org creativecommons\.org/licenses/by-nc-sa(?:/[\d.]+)?
cc-by-nc 0.97 creativecommons.org creativecommons\.org/licenses/by-nc(?:/[\d.]+)?
cc-by-nd 0.97 creativecommons.org creativecommons\.org/licenses/by-nd(?:/[\d.]+)?
cc-by-sa 0.97 creativecommons.org creativecommons\.org/licenses/by-sa(?:/[\d.]+)?
cc-by 0.97 creativecommons.org creativecommons\.org/licenses/by(?:/[\d.]+)?
cc0-1.0 0.99 creativecommons.org creativecommons\.org/publicdomain/zero/1\.0
public-domain 0.97 creativecommons.org creativecommons\.org/publicdomain/mark/1\.0
# Creative Commons, by name
cc-by-nc-nd-4.0 0.98 creative+commons creative commons attribution[ -]+non-?commercial[ -]+no ?deriv(?:ative)?s?(?: works)? 4\.0
cc-by-nc-sa-4.0 0.98 creative+commons creative commons attribution[ -]+non-?commercial[ -]+share ?alike 4\.0
cc-by-nc-4.0 0.98 creative+commons creative commons attribution[ -]+non-?commercial 4\.0
cc-by-nd-4.0 0.98 creative+commons creative commons attribution[ -]+no ?deriv(?:ative)?s?(?: works)? 4\.0
cc-by-sa-4.0 0.98 creative+commons creative commons attribution[ -]+share ?alike 4\.0
cc-by-4.0 0.98 creative+commons creative commons attribution 4\.0
cc-by-sa-3.0 0.98 creative+commons creative commons attribution[ -]+share ?alike 3\.0
cc-by-3.0 0.98 creative+commons creative commons attribution 3\.0
cc-by-2.5 0.98 creative+commons creative commons attribution 2\.5
cc-by-2.0 0.98 creative+commons creative commons attribution 2\.0
cc-by-nc-nd 0.9 creative+commons creative commons attribution[ -]+non-?commercial[ -]+no ?deriv(?:ative)?s?
cc-by-nc-sa 0.9 creative+commons creative commons attribution[ -]+non-?commercial[ -]+share ?alike
cc-by-nc 0.9 creative+commons creative commons attribution[ -]+non-?commercial
cc-by-nd 0.9 creative+commons creative commons attribution[ -]+no ?deriv(?:ative)?s?
cc-by-sa 0.9 creative+commons creative commons attribution[ -]+share ?alike
cc-by 0.9 creative+commons creative commons attribution
cc0 0.9 creative+commons creative commons (?:zero|cc0)
creative-commons 0.6 creative+commons creative commons licen[cs]e
cc-by-nc-nd-4.0 0.97 cc+by \bcc[ -]by[ -]nc[ -]nd[ -]4\.0\b
cc-by-nc-sa-4.0 0.97 cc+by \bcc[ -]by[ -]nc[ -]sa[ -]4\.0\b
cc-by-nc-4.0 0.97 cc+by \bcc[ -]by[ -]nc[ -]4\.0\b
cc-by-nd-4.0 0.97 cc+by \bcc[ -]by[ -]nd[ -]4\.0\b
cc-by-sa-4.0 0.97 cc+by \bcc[ -]by[ -]sa[ -]4\.0\b
cc-by-4.0 0.97 cc+by \bcc[ -]by[ -]4\.0\b
cc-by-sa-3.0 0.97 cc+by \bcc[ -]by[ -]sa[ -]3\.0\b
cc-by-3.0 0.97 cc+by \bcc[ -]by[ -]3\.0\b
cc-by-nc-nd 0.9 cc+by \bcc[ -]by[ -]nc[ -]nd\b
cc-by-nc-sa 0.9 cc+by \bcc[ -]by[ -]nc[ -]sa\b
cc-by-nc 0.9 cc+by \bcc[ -]by[ -]nc\b
cc-by-nd 0.9 cc+by \bcc[ -]by[ -]nd\b
cc-by-sa 0.9 cc+by \bcc[ -]by[ -]sa\b
cc-by 0.85 cc+by \bcc[ -]by\b
cc0-1.0 0.95 cc0 \bcc0[ -]1\.0\b
cc0 0.85 cc0 \bcc0\b
# GNU licenses: their own notices, then names
agpl-3.0-or-later 0.97 affero (?:gnu )?affero general public license,? as published by the free software foundation,? either version 3 of the license,? or (?:\(at your option\) )?any later version
agpl-3.0 0.97 affero (?:gnu )?affero general public license,? ?(?:version |v\.? ?)3(?:\.0)?
agpl-1.0 0.97 affero affero general public license,? ?(?:version |v\.? ?)1(?:\.0)?
agpl 0.85 affero (?:gnu )?affero general public license
agpl-3.0 0.9 agpl \bagpl[ -]?v?3(?:\.0)?\b
agpl 0.7 agpl \bagpl\b
lgpl-2.1-or-later 0.97 lesser (?:gnu )?lesser general public license as published by the free software foundation; either version 2\.1 of the license,? or (?:\(at your option\) )?any later version
lgpl-3.0-or-later 0.97 lesser (?:gnu )?lesser general public license as published by the free software foundation[;,] either version 3 of the license,? or (?:\(at your option\) )?any later version
lgpl-3.0 0.97 lesser (?:gnu )?lesser general public license,? ?(?:version |v\.? ?)3(?:\.0)?
lgpl-2.1 0.97 lesser (?:gnu )?lesser general public license,? ?(?:version |v\.? ?)2\.1
lgpl 0.85 lesser (?:gnu )?lesser general public license
lgpl-2.0 0.97 library+general (?:gnu )?library general public license,? ?(?:version |v\.? ?)2(?:\.0)?
lgpl 0.85 library+general (?:gnu )?library general public license
lgpl-3.0 0.9 lgpl \blgpl[ -]?v?3(?:\.0)?\b
lgpl-2.1 0.9 lgpl \blgpl[ -]?v?2\.1\b
lgpl 0.7 lgpl \blgpl\b
gpl-3.0-or-later 0.97 redistribute+general redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation[;,] either version 3 of the license,? or (?:\(at your option\) )?any later version
gpl-2.0-or-later 0.97 redistribute+general redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation[;,] either version 2 of the license,? or (?:\(at your option\) )?any later version
gpl 0.9 redistribute+general redistribute it and/or modify it under the terms of the gnu general public license
gpl-3.0 0.97 general+public (?:gnu )?general public license,? ?(?:version |v\.? ?)3(?:\.0)?
gpl-2.0 0.97 general+public (?:gnu )?general public license,? ?(?:version |v\.? ?)2(?:\.0)?
gpl-1.0 0.97 general+public (?:gnu )?general public license,? ?(?:version |v\.? ?)1(?:\.0)?
gpl 0.85 general+public (?:gnu )?general public license
gpl-classpath 0.9 classpath classpath exception
gpl-3.0 0.9 gpl \bgpl[ -]?v?3(?:\.0)?\b
gpl-2.0 0.9 gpl \bgpl[ -]?v?2(?:\.0)?\b
gfdl-1.3 0.97 documentation+licen (?:gnu )?free documentation license,? ?(?:version |v\.? ?)1\.3
gfdl-1.2 0.97 documentation+licen (?:gnu )?free documentation license,? ?(?:version |v\.? ?)1\.2
gfdl-1.1 0.97 documentation+licen (?:gnu )?free documentation license,? ?(?:version |v\.? ?)1\.1
gfdl 0.85 documentation+licen (?:gnu )?free documentation license
gpl-address 0.8 gnu.org gnu\.org/licenses/(?:old-licenses/)?[a-z]*gpl[a-z0-9.-]*
# Apache
apache-2.0 0.99 apache licensed under the apache license,? version 2\.0
apache-2.0 0.97 apache \bapache(?: software)?(?: license)?(?:,? (?:version |v\.? ?)|[ -])2\.0\b
apache-1.1 0.97 apache \bapache(?: software)?(?: license)?(?:,? (?:version |v\.? ?)|[ -])1\.1\b
apache-1.0 0.97 apache \bapache(?: software)?(?: license)?(?:,? (?:version |v\.? ?)|[ -])1\.0\b
apache-2.0 0.98 apache apache\.org/licenses/license-2\.0
apache 0.9 apache (?:licensed|released|distributed) under (?:the )?(?:terms of the )?apache(?: software)?(?: license)?
apache 0.8 apache \bapache(?: software)? license\b
apache 0.8 apache contributor license agreements?\. see the notice file[\s\S]{1,200}? apache
# MIT, X11, ISC and their like
mit 0.95 hereby+permission permission is hereby granted, free of charge, to any person obtaining a copy
boost 0.9 hereby+permission permission is hereby granted[\s\S]{1,120}?to any person or organization
mit-modern 0.8 hereby+permission permission to use, copy, modify, and distribute this software and its documentation for any purpose,? (?:and without fee )?is hereby granted
mit 0.95 mit+under (?:licensed|released|distributed) under (?:the )?(?:terms of the )?mit(?: license)?
mit 0.9 mit+licen \bmit license(?: \(mit\))?
mit 0.9 mit+licen \blicense: ?mit\b
x11 0.9 x11 \bx11 license\b
expat 0.9 expat \bexpat license\b
mit 0.6 noninfringement fitness for a particular purpose and noninfringement
isc 0.95 permission+purpose permission to use, copy, modify,? and/?(?:or)? distribute this software for any purpose
isc 0.9 isc+licen \bisc license\b
bsd-0-clause 0.9 0bsd \b0bsd\b
# BSD
bsd-4-clause 0.95 acknowledgement all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-3-clause 0.9 contributors+neither neither the names? of [\s\S]{1,200}? nor the names of (?:its|their) contributors
bsd 0.9 redistribution redistribution and use in source and binary forms, with or without modification
bsd-2-clause 0.9 bsd (?:simplified|2-clause|two-clause|freebsd) bsd(?: license)?
bsd-3-clause 0.9 bsd (?:new|revised|modified|3-clause|three-clause) bsd(?: license)?
bsd-4-clause 0.9 bsd (?:original|4-clause|four-clause) bsd(?: license)?
bsd-2-clause 0.9 bsd \bbsd[ -](?:2|two)[ -]clause\b
bsd-3-clause 0.9 bsd \bbsd[ -](?:3|three)[ -]clause\b
bsd 0.8 bsd (?:licensed|released|distributed) under (?:the )?(?:terms of the )?bsd(?:[- ]style)?(?: license)?
bsd 0.75 bsd \bbsd(?:[- ]style)? license\b
# Mozilla, Eclipse, Sun, IBM
mpl-2.0 0.97 mozilla mozilla public license,? ?(?:version |v\.? ?)?2\.0
mpl-1.1 0.97 mozilla mozilla public license,? ?(?:version |v\.? ?)?1\.1
mpl-1.0 0.97 mozilla mozilla public license,? ?(?:version |v\.? ?)?1\.0
mpl 0.85 mozilla mozilla public license
mpl-2.0 0.95 mozilla mozilla\.org/mpl/2\.0
epl-2.0 0.97 eclipse eclipse public license(?:,? (?:version |v\.? ?)?| - v ?)2\.0
epl-1.0 0.97 eclipse eclipse public license(?:,? (?:version |v\.? ?)?| - v ?)1\.0
epl 0.85 eclipse eclipse public license
edl-1.0 0.9 eclipse eclipse distribution license(?:,? v?\.? ?1\.0)?
cddl-1.1 0.97 distribution+development common development and distribution license,? ?(?:\(cddl\) )?(?:version |v\.? ?)?1\.1
cddl-1.0 0.97 distribution+development common development and distribution license,? ?(?:\(cddl\) )?(?:version |v\.? ?)?1\.0
cddl 0.85 distribution+development common development and distribution license
cddl 0.8 cddl \bcddl[ -]1\.[01]\b
cpl-1.0 0.95 common+public common public license,? ?(?:version |v\.? ?)?1\.0
cpl 0.85 common+public common public license
ipl-1.0 0.9 ibm+public \bibm public license(?:,? (?:version |v\.? ?)?1\.0)?
spl-1.0 0.9 sun+public \bsun public license(?:,? (?:version |v\.? ?)?1\.0)?
# Languages, tools and foundations
python-2.0 0.95 python+licen python software foundation license,? ?(?:version |v\.? ?)?2
python 0.85 python+licen python(?: software foundation)? license
php-3.01 0.95 php+licen \bphp license,? ?(?:version |v\.? ?)?3\.01
php-3.0 0.95 php+licen \bphp license,? ?(?:version |v\.? ?)?3\.0
php 0.8 php+licen \bphp license\b
ruby 0.8 ruby+licen \bruby license\b
perl 0.85 perl+terms under the same terms as perl itself
artistic-2.0 0.95 artistic artistic license,? ?(?:version |v\.? ?)?2\.0
artistic-1.0 0.95 artistic artistic license,? ?(?:version |v\.? ?)?1\.0
artistic 0.85 artistic artistic license
postgresql 0.9 postgresql postgresql license
openssl 0.9 openssl openssl (?:license|toolkit)
openssl 0.8 openssl this product includes software developed by the openssl project
vim 0.8 vim+licen \bvim license\b
curl 0.8 curl+licen \bcurl license\b
tcl 0.8 tcl+licen \btcl/tk license\b
zpl-2.1 0.9 zope \bzope public license(?:,? (?:version |v\.? ?)?2\.[01])?
w3c 0.9 w3c w3c(?:®)? software(?: and document)?(?: notice and)? license
unicode 0.9 unicode \bunicode(?:,? inc\.)? license(?: agreement)?
libpng 0.9 libpng \blibpng license\b
libtiff 0.8 libtiff \blibtiff license\b
ijg 0.8 jpeg this software is based in part on the work of the independent jpeg group
ncsa 0.9 ncsa \b(?:university of illinois/)?ncsa open source license\b
afl-3.0 0.9 academic \bacademic free license(?:,? (?:version |v\.? ?)?3\.0)?
osl-3.0 0.9 open+software \bopen software license(?:,? (?:version |v\.? ?)?3\.0)?
qpl-1.0 0.9 public+license \bq public license(?:,? (?:version |v\.? ?)?1\.0)?
upl-1.0 0.9 universal \buniversal permissive license(?:,? (?:version |v\.? ?)?1\.0)?
cecill 0.9 cecill \bcecill(?:-[bc])?(?: (?:version |v\.? ?)?[12](?:\.[01])?)?(?: licen[cs]e)?
eupl-1.2 0.97 european+union european union public licen[cs]e,? ?(?:version |v\.? ?)?1\.2
eupl-1.1 0.97 european+union european union public licen[cs]e,? ?(?:version |v\.? ?)?1\.1
eupl 0.85 european+union european union public licen[cs]e
boost-1.0 0.97 boost boost software license,? ?(?:version |v\.? ?|- version )?1\.0
boost 0.85 boost boost software license
zlib 0.9 as-is this software is provided 'as-is', without any express or implied warranty
zlib 0.85 zlib \bzlib(?:/libpng)? license\b
unlicense 0.95 unencumbered this is free and unencumbered software released into the public domain
unlicense 0.85 unlicense \b(?:the )?unlicense\b
wtfpl 0.9 want+public do what the f\S* you want to public license
wtfpl 0.85 wtfpl \bwtfpl\b
beerware 0.9 beer+licen \bbeer-?ware license\b
json 0.8 evil+software the software shall be used for good, not evil
# Fonts, data, models, source-available
ofl-1.1 0.95 font+licen (?:sil )?open font license,? ?(?:version |v\.? ?)?1\.1
ofl-1.0 0.95 font+licen (?:sil )?open font license,? ?(?:version |v\.? ?)?1\.0
ofl 0.85 font+licen (?:sil )?open font license
odbl-1.0 0.95 database+licen open database license(?: \(odbl\))?(?:,? (?:version |v\.? ?)?1\.0)?
odc-by-1.0 0.9 commons+attribution open data commons attribution license(?:,? (?:version |v\.? ?)?1\.0)?
pddl-1.0 0.9 domain+dedication public domain dedication and licen[cs]e
cdla 0.9 community+data community data license agreement
openrail-m 0.9 openrail \b(?:creativeml |bigscience )?(?:open)rail(?:[+-]{1,2}m)\b
openrail 0.85 openrail \bopenrail(?: license)?\b
llama 0.85 community+llama \bllama [\d.]+ community license(?: agreement)?
elastic-2.0 0.9 elastic+licen \belastic license(?:,? (?:version |v\.? ?)?2\.0)?
sspl-1 0.9 server+side server side public license(?:,? (?:version |v\.? ?)?1)?
busl-1.1 0.9 business+source business source license(?:,? (?:version |v\.? ?)?1\.1)?
commons-clause 0.9 commons+clause \bcommons clause(?: license condition)?
polyform 0.9 polyform \bpolyform (?:noncommercial|small business|shield|strict|perimeter)(?: license)?
ms-pl 0.9 microsoft+licen microsoft public license
ms-rl 0.9 reciprocal microsoft reciprocal license
ms-eula 0.7 microsoft+licen microsoft software license terms
nvidia 0.7 nvidia \bnvidia (?:software|cuda) license(?: agreement)?
ogl-3.0 0.9 government \bopen government licen[cs]e(?: v?3\.0)?
# Notices
public-domain 0.8 domain+public (?:released|dedicated|placed) (?:in)?to the public domain
public-domain 0.7 domain+public (?:is )?in the public domain
public-domain 0.7 domain+public has been (?:put|placed) in the public domain
no-rights 0.8 rights+reserved no rights reserved
reserved 0.6 rights+reserved all rights reserved
some-rights 0.6 rights+reserved some rights reserved
copyright 0.5 copyright copyright (?:\(c\) |© ?)?(?:19|20)\d\d(?: ?[-–,] ?(?:19|20)?\d\d)*
copyright 0.5 © © ?(?:copyright )?(?:19|20)\d\d
proprietary 0.8 proprietary \bproprietary and confidential\b
proprietary 0.7 proprietary \bproprietary licen[cs]e\b
proprietary 0.7 reproduced+permission may not be reproduced (?:in any form )?without (?:prior )?(?:written )?permission
proprietary 0.7 unauthori unauthori[sz]ed (?:copying|use|reproduction|distribution) of this (?:file|software|material|document)[\s\S]{1,60}? (?:is )?strictly prohibited
non-commercial 0.7 commercial for non-?commercial (?:use|purposes) only
non-commercial 0.7 personal for personal(?: and| or|,) non-?commercial use
research-only 0.7 research for research (?:use|purposes) only
educational 0.6 educational for educational (?:use|purposes) only
evaluation 0.6 evaluation for evaluation (?:use|purposes) only
no-warranty 0.5 warranty without warranty of any kind
no-warranty 0.5 warranty without even the implied warranty of merchantability
no-warranty 0.5 as+conditions on an "as is" basis, without warranties or conditions of any kind
eula 0.6 end+licen \bend[ -]user licen[cs]e agreement\b
trademark 0.4 trademark (?:is a |are )?registered trademarks? of
patent 0.4 patent subject to (?:the )?(?:terms of )?the patent licen[cs]e
"""


def spaced(expression: str) -> str:
    """The expression with GAP for its blanks."""
    for old, new in (("[ -]+", f"(?:{GAP}|-)+"), ("[ -]", f"(?:{GAP}|-)"), ("[- ]", f"(?:{GAP}|-)"), (" ?", f"(?:{GAP})?"), (" ", GAP)):
        expression = expression.replace(old, new)
    return expression


def read(lines: str = LINES) -> list[tuple[str, float, str, str, str]]:
    """Label, weight, keyword, second word (or none) and expression of each rule."""
    out = []
    for line in lines.strip().splitlines():
        if not line.startswith("#"):
            label, weight, words, expression = line.split(" ", 3)
            keyword, _, also = words.partition("+")
            out.append((label, float(weight), keyword, also, spaced(expression)))
    return out


RULES = read()
