"""License scan with ordered signature rules.

A text is reduced to its lower-cased words joined by one space. A rule is a regular expression over these, a label, a
priority, a confidence and the words that a text must hold before the expression is tried at all. The rules that fire
give intervals of words; an interval inside another one of at least its priority is suppressed, so that
"licensed under the apache license version 2 0" gives one detection and not four. The labels of those that are left,
together with the four base labels, are reported.

There are three kinds of rules: TEXTS, hand-written signatures of license texts, headers and notices, one each;
LICENSES, hand-written expressions for the names of licenses, each in the FORMS in which licenses are cited; and IDENTIFIERS, short
names that are ordinary words or abbreviations and mean a license only where they are cited as one: behind an identifier tag
(also joined there by "or" and "and"), in a license field, or behind "licensed under" and the like. Rules are
found by their first gate word, so that a text without any of these words costs one look-up a word. Positions are looked
up, and intervals swept in order of their start, so that a text that is one long list of notices costs n log n.

Defined cases: null or empty text has no words and no labels; texts are scanned whole; equal intervals of equal priority
keep the earlier rule; repeated rows give repeated results; an empty table gives an empty result; other columns are not
looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexloom.llm.common import table

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, words that must be there, expression for the name (over words joined by one space)
LICENSES = [
    ("agpl-3.0", "affero", r"gnu affero general public licen[cs]e(?: (?:version|v) 3(?: 0)?)?"),
    ("agpl-3.0", "agpl", r"agpl(?: v?3(?: 0)?)?"),
    ("agpl-3.0", "agplv3", r"agplv3"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[cs]e (?:version|v) 2(?: 1)?"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public licen[cs]e (?:version|v) 3(?: 0)?"),
    ("lgpl", "lesser", r"gnu lesser general public licen[cs]e"),
    ("lgpl", "lgpl", r"lgpl(?: v?[23](?: [01])?)?"),
    ("lgpl-2.0", "library", r"gnu library general public licen[cs]e"),
    ("gpl-1.0", "general", r"gnu general public licen[cs]e (?:version|v) 1(?: 0)?"),
    ("gpl-2.0", "general", r"gnu general public licen[cs]e (?:version|v) 2(?: 0)?"),
    ("gpl-2.0", "gpl", r"gnu gpl (?:version |v )?v?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"gnu gpl (?:version |v )?v?3(?: 0)?"),
    ("gpl", "gpl", r"gnu gpl"),
    ("gpl-2.0", "gplv2", r"gplv2"),
    ("gpl-3.0", "general", r"gnu general public licen[cs]e (?:version|v) 3(?: 0)?"),
    ("gpl-3.0", "gplv3", r"gplv3"),
    ("gfdl", "documentation", r"gnu free documentation licen[cs]e(?: (?:version|v) 1 [0-3])?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[cs]e (?:version|v) 1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[cs]e(?: (?:version|v))? 2(?: 0)?"),
    ("apache-2.0", "apache", r"apache 2 0"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?"),
    ("cc0-1.0", "zero", r"creative commons zero(?: (?:v|version)? ?1 0)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: \d 0)?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: \d 0)?"),
    ("cc-by-nc", "cc", r"cc by nc(?: \d 0)?"),
    ("cc-by-nd", "cc", r"cc by nd(?: \d 0)?"),
    ("cc-by-sa", "cc", r"cc by sa(?: \d 0)?"),
    ("cc-by", "cc", r"cc by(?: \d 0)?"),
    ("cc-by-nc-nd", "commons", r"creative commons attribution non ?commercial no ?deriv(?:ative|s|atives)(?: works)?(?: \d 0)?"),
    ("cc-by-nc-sa", "commons", r"creative commons attribution non ?commercial share ?alike(?: \d 0)?"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial(?: \d 0)?"),
    ("cc-by-nd", "commons", r"creative commons attribution no ?deriv(?:ative|s|atives)(?: works)?(?: \d 0)?"),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike(?: \d 0)?"),
    ("cc-by", "commons", r"creative commons attribution(?: \d 0)?"),
    ("mit", "mit", r"mit licen[cs]e"),
    ("mit", "expat", r"expat licen[cs]e"),
    ("mit-0", "attribution", r"mit no attribution"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("bsd-2-clause", "bsd", r"bsd 2 clause|simplified bsd"),
    ("bsd-3-clause", "bsd", r"bsd 3 clause|(?:new|modified|revised) bsd"),
    ("bsd-4-clause", "bsd", r"bsd 4 clause|original bsd"),
    ("bsd", "bsd", r"bsd licen[cs]e"),
    ("0bsd", "0bsd", r"0bsd"),
    ("0bsd", "zero", r"zero clause bsd"),
    ("isc", "isc", r"isc licen[cs]e"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e (?:version|v) 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e(?: (?:version|v) 2(?: 0)?)?"),
    ("mpl-2.0", "mpl", r"mpl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e (?:version|v) 1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e(?: (?:version|v) 2(?: 0)?)?"),
    ("eupl-1.2", "union", r"european union public licen[cs]e(?: (?:version|v) 1 2)?"),
    ("eupl-1.2", "eupl", r"eupl(?: v?1 2)?"),
    ("cddl-1.0", "cddl", r"cddl(?: 1 0)?"),
    ("cddl-1.0", "distribution", r"common development and distribution licen[cs]e"),
    ("cpl-1.0", "common", r"common public licen[cs]e"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e(?: 2 0)?"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?: (?:version )?1 0)?"),
    ("busl-1.1", "business", r"business source licen[cs]e(?: 1 1)?"),
    ("sspl-1.0", "server", r"server side public licen[cs]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("zlib", "zlib", r"zlib licen[cs]e"),
    ("libpng", "libpng", r"libpng licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("python-2.0", "python", r"python software foundation licen[cs]e(?: (?:version )?2)?"),
    ("php-3.01", "php", r"php licen[cs]e(?: (?:version )?3 01)?"),
    ("ruby", "ruby", r"ruby licen[cs]e"),
    ("ofl-1.1", "sil", r"sil open font licen[cs]e(?: (?:version )?1 1)?"),
    ("odbl-1.0", "database", r"open (?:data commons )?(?:open )?database licen[cs]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e"),
    ("public-domain", "domain", r"public domain"),
]
_V, _LATER = r" (?:version |v )?v?", r"(?: only| or (?:any )?later(?: version)?)?"
#: label, word that must be there, expression for the short name
IDENTIFIERS = [
    ("mit", "mit", r"mit"),
    ("mit-0", "mit", r"mit 0"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib"),
    ("libpng", "libpng", r"libpng(?: 2 0)?"),
    ("gpl-1.0", "gpl", rf"(?:gnu )?gpl{_V}1(?: 0)?{_LATER}"),
    ("gpl-2.0", "gpl", rf"(?:gnu )?gpl{_V}2(?: 0)?{_LATER}"),
    ("gpl-3.0", "gpl", rf"(?:gnu )?gpl{_V}3(?: 0)?{_LATER}"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("lgpl-2.0", "lgpl", rf"(?:gnu )?lgpl{_V}2(?: 0)?{_LATER}"),
    ("lgpl-2.1", "lgpl", rf"(?:gnu )?lgpl{_V}2 1{_LATER}"),
    ("lgpl-3.0", "lgpl", rf"(?:gnu )?lgpl{_V}3(?: 0)?{_LATER}"),
    ("agpl-3.0", "agpl", rf"(?:gnu )?agpl{_V}3(?: 0)?{_LATER}"),
    ("gfdl", "gfdl", rf"(?:gnu )?gfdl(?:{_V}1 [0-3])?{_LATER}"),
    ("apache-1.1", "apache", rf"apache{_V}1 1"),
    ("apache-2.0", "apache", rf"apache{_V}2(?: 0)?"),
    ("bsd", "bsd", r"bsd(?! [234] clause)"),
    ("x11", "x11", r"x11"),
    ("mpl-1.1", "mpl", rf"mpl{_V}1 1"),
    ("mpl-2.0", "mpl", rf"mpl(?:{_V}2(?: 0)?)?"),
    ("epl-1.0", "epl", rf"epl{_V}1(?: 0)?"),
    ("epl-2.0", "epl", rf"epl{_V}2(?: 0)?"),
    ("cpl-1.0", "cpl", rf"cpl{_V}1 0"),
    ("bsl-1.0", "bsl", rf"bsl{_V}1 0"),
    ("busl-1.1", "busl", r"busl(?: 1 1)?"),
    ("sspl-1.0", "sspl", r"sspl(?: v?1(?: 0)?)?"),
    ("artistic-2.0", "artistic", rf"artistic{_V}2(?: 0)?"),
    ("openssl", "openssl", r"openssl"),
    ("postgresql", "postgresql", r"postgresql"),
    ("python-2.0", "python", r"python 2 0"),
    ("python-2.0", "psf", r"psf(?: 2 0)?"),
    ("php-3.01", "php", r"php 3 01"),
    ("ofl-1.1", "ofl", r"(?:sil )?ofl(?: v?1 [01])?"),
    ("odbl-1.0", "odbl", r"odbl(?: v?1 0)?"),
    ("ms-pl", "ms", r"ms pl"),
    ("ms-rl", "ms", r"ms rl"),
    ("ncsa", "ncsa", r"ncsa"),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: 2 [01])?"),
]
#: The forms below in which a short name is cited, and one more of their own: further on in an identifier tag's expression. What a
#: detection covers begins at "own", if there is that.
CITED = ("identifier", "granted", "released", "field")
JOINED = ("joined", r"spdx licen[cs]e identifier (?:\S+ ){1,16}?(?:or|and)(?P<own>) ", "", 5, 1.0, "spdx")
#: form, what stands before and after the name, priority, confidence, and another word that must be there
FORMS = [
    ("identifier", r"spdx licen[cs]e identifier ", "", 5, 1.0, "spdx"),
    ("granted", r"(?:is |are )?(?:dual |re|co )?licen[cs]ed (?:to you )?under (?:the |an? )?(?:terms of )?(?:the |an? )?", "", 4, 0.95, "under"),
    ("released", r"(?:is |are |made )?(?:re)?(?:leased|distributed|published|available|provided|offered) under (?:the |an? )?(?:terms of )?(?:the |an? )?", "", 4, 0.95, "under"),
    ("terms", r"(?:terms|conditions|provisions) of (?:the )?", "", 3, 0.85, "of"),
    ("copy", r"copy of (?:the )?", "", 3, 0.8, "copy"),
    ("details", r"see (?:the )?", r" for (?:more |full |further )?(?:details|information|terms)", 3, 0.8, "see"),
    ("field", r"licen[cs]e (?:type |name |is )?", "", 2, 0.7, "license"),
    ("name", "", "", 1, 0.6, None),
]
#: Signatures of license texts, headers and notices: label, gate word, expression over words joined by one space, priority, confidence.
TEXTS = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?", 5, 0.98),
    ("mit", "restriction", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish", 5, 0.98),
    ("mit", "portions", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software", 5, 0.98),
    ("mit", "merchantability", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 4, 0.9),
    ("mit-0", "furnished", r"permit persons to whom the software is furnished to do so the software is provided as is", 5, 0.98),
    ("x11", "consortium", r"the name of the x consortium shall not be used in advertising", 5, 0.98),
    ("x11-distribute", "advertising", r"except as contained in this notice the name s? ?of the above copyright holders shall not be used in advertising", 5, 0.95),
    ("ncsa", "restriction", r"to deal with the software without restriction including without limitation", 5, 0.98),
    ("isc", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 5, 0.98),
    ("0bsd", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 5, 0.98),
    ("isc", "purpose", r"permission to use copy modify and or distribute this software for any purpose", 4, 0.9),
    ("curl", "hereby", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 5, 0.95),
    ("ntp", "documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", 5, 0.95),
    ("hpnd", "documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", 5, 0.95),
    ("libtiff", "sell", r"permission to use copy modify distribute and sell this software and its documentation for any purpose", 5, 0.95),
    ("postgresql", "agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 5, 0.98),
    ("postgresql", "california", r"in no event shall the university of california be liable to any party for direct indirect special", 4, 0.9),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification(?: are permitted provided that the following conditions are met)?", 4, 0.95),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions", 4, 0.95),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions", 4, 0.95),
    ("bsd", "contributors", r"this software is provided by the (?:copyright holders and contributors|author|authors|regents)(?: and contributors)? as is and any express or implied warranties", 4, 0.9),
    ("bsd-3-clause", "endorse", r"(?:neither )?the names? of (?:the )?(?:\S+ ){1,12}(?:nor the names of (?:its|their|other) contributors )?may(?: not)? be used to endorse or promote products derived from", 5, 0.97),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 5, 0.98),
    ("bsd-2-clause-views", "views", r"the views and conclusions contained in the software and documentation are those of the authors", 5, 0.95),
    ("bsd-2-clause-patent", "perpetual", r"each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide", 5, 0.95),
    ("bsd-3-clause-clear", "patent", r"no express or implied licenses to any party s patent rights are granted by this license", 5, 0.95),
    ("bsd-3-clause-nuclear", "nuclear", r"not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility", 5, 0.95),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license(?: you may obtain a copy of the license at)?", 4, 0.9),
    ("apache-2.0", "apache", r"licensed under the apache license version 2 0 the license", 5, 0.99),
    ("apache-2.0", "apache", r"apache license version 2 0 january 2004", 5, 0.99),
    ("apache-2.0", "apache", r"(?:http|https) (?:www )?apache org licenses license 2 0(?: txt| html)?", 5, 0.98),
    ("apache-2.0", "apache", r"licensed to the apache software foundation asf under one or more contributor license agreements", 5, 0.98),
    ("apache-2.0", "basis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 4, 0.93),
    ("apache-2.0", "reproduction", r"terms and conditions for use reproduction and distribution 1 definitions", 4, 0.9),
    ("apache-1.1", "apache", r"this product includes software developed by the apache (?:software foundation|group)", 5, 0.9),
    ("apache-1.1", "redistribution", r"the end user documentation included with the redistribution if any must include the following acknowledge?ment", 5, 0.9),
    ("gpl-1.0", "gnu", r"gnu general public license version 1 february 1989", 5, 0.99),
    ("gpl-2.0", "gnu", r"gnu general public license version 2 june 1991", 5, 0.99),
    ("gpl-3.0", "gnu", r"gnu general public license version 3 29 june 2007", 5, 0.99),
    ("gpl-1.0-or-later", "later", r"under the terms of the gnu general public license as published by the free software foundation either version 1 (?:of the license )?or at your option any later version", 5, 0.98),
    ("gpl-2.0-or-later", "later", r"under the terms of the gnu general public license as published by the free software foundation either version 2 (?:of the license )?or at your option any later version", 5, 0.98),
    ("gpl-3.0-or-later", "later", r"under the terms of the gnu general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version", 5, 0.98),
    ("gpl-2.0-only", "gnu", r"under the terms of (?:version 2 of the gnu general public license|the gnu general public license version 2 (?:only )?as published)", 5, 0.97),
    ("gpl-3.0-only", "gnu", r"under the terms of (?:version 3 of the gnu general public license|the gnu general public license version 3 (?:only )?as published)", 5, 0.97),
    ("gpl-2.0", "freedom", r"the licenses for most software are designed to take away your freedom to share and change it", 5, 0.97),
    ("gpl-3.0", "copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works", 5, 0.98),
    ("gpl", "hope", r"(?:this program|it) is distributed in the hope that it will be useful but without any warranty", 3, 0.8),
    ("gpl", "gnu", r"you should have received a copy of the gnu general public license along with", 4, 0.93),
    ("gpl-classpath-exception", "linking", r"linking this library statically or dynamically with other modules is making a combined work based on this library", 5, 0.97),
    ("gpl-bison-exception", "bison", r"you may create a larger work that contains part or all of the bison parser skeleton", 5, 0.97),
    ("gpl-gcc-exception", "gcc", r"gcc runtime library exception", 5, 0.95),
    ("gpl-font-exception", "font", r"if you create a document which uses this font and embed this font", 5, 0.95),
    ("gpl-openssl-exception", "openssl", r"permission to link the code of (?:portions of )?this program with the openssl library", 5, 0.95),
    ("lgpl-2.0", "gnu", r"gnu library general public license version 2 june 1991", 5, 0.99),
    ("lgpl-2.1", "gnu", r"gnu lesser general public license version 2 1 february 1999", 5, 0.99),
    ("lgpl-3.0", "gnu", r"gnu lesser general public license version 3 29 june 2007", 5, 0.99),
    ("lgpl-2.0-or-later", "library", r"gnu library general public license as published by the free software foundation either version 2 (?:of the license )?or at your option any later version", 5, 0.98),
    ("lgpl-2.1-or-later", "lesser", r"gnu lesser general public license as published by the free software foundation either version 2 1 (?:of the license )?or at your option any later version", 5, 0.98),
    ("lgpl-3.0-or-later", "lesser", r"gnu lesser general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version", 5, 0.98),
    ("lgpl-3.0", "incorporates", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", 5, 0.98),
    ("lgpl", "lesser", r"you should have received a copy of the gnu (?:lesser|library) general public license along with", 4, 0.93),
    ("lgpl", "designated", r"this license the (?:lesser|library) general public license applies to (?:some|certain) specially designated (?:software packages|libraries)", 5, 0.95),
    ("agpl-3.0", "affero", r"gnu affero general public license version 3 19 november 2007", 5, 0.99),
    ("agpl-3.0-or-later", "affero", r"gnu affero general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version", 5, 0.98),
    ("agpl-3.0", "remotely", r"your modified version must prominently offer all users interacting with it remotely through a computer network", 5, 0.98),
    ("agpl-3.0", "affero", r"you should have received a copy of the gnu affero general public license along with", 4, 0.93),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts", 5, 0.97),
    ("gfdl", "document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 5, 0.98),
    ("gfdl", "textbook", r"the purpose of this license is to make a manual textbook or other functional and useful document free", 5, 0.98),
    ("fsf-unlimited", "unlimited", r"the free software foundation gives unlimited permission to copy and or distribute it", 5, 0.97),
    ("fsf-all-permissive", "royalty", r"copying and distribution of this file with or without modification are permitted in any medium without royalty", 5, 0.97),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v ?2 0", 5, 0.99),
    ("mpl-2.0", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", 4, 0.95),
    ("mpl-2.0-no-copyleft-exception", "incompatible", r"this source code form is incompatible with secondary licenses as defined by the mozilla public license", 5, 0.97),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 [01]", 5, 0.98),
    ("npl-1.1", "netscape", r"the contents of this file are subject to the netscape public license", 5, 0.98),
    ("epl-1.0", "eclipse", r"made available under the terms of the eclipse public license (?:v ?|version )?1 0", 5, 0.98),
    ("epl-2.0", "eclipse", r"made available under the terms of the eclipse public license (?:v ?|version )?2 0", 5, 0.98),
    ("epl", "eclipse", r"the accompanying program is provided under the terms of this eclipse public license", 5, 0.97),
    ("edl-1.0", "eclipse", r"eclipse distribution license(?: v ?1 0)?", 4, 0.9),
    ("cpl-1.0", "common", r"the accompanying program is provided under the terms of this common public license", 5, 0.98),
    ("ipl-1.0", "ibm", r"the accompanying program is provided under the terms of this ibm public license", 5, 0.98),
    ("cddl-1.0", "distribution", r"the contents of this file are subject to the terms of the common development and distribution license", 5, 0.98),
    ("cddl-1.0", "cddl", r"common development and distribution license cddl version 1 [01]", 5, 0.98),
    ("eupl-1.2", "licence", r"european union public licence (?:v ?|version )1 2", 5, 0.98),
    ("eupl-1.1", "licence", r"european union public licence (?:v ?|version )1 1", 5, 0.98),
    ("artistic-1.0", "artistic", r"the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", 5, 0.98),
    ("artistic-2.0", "package", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed", 5, 0.98),
    ("perl", "perl", r"under the same terms as (?:the )?perl (?:5 )?(?:programming language )?(?:system )?itself", 5, 0.95),
    ("bsl-1.0", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 5, 0.98),
    ("bsl-1.0", "boost", r"boost software license version 1 0 august 17th 2003", 5, 0.99),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 5, 0.99),
    ("unlicense", "anyone", r"anyone is free to copy modify publish use compile sell or distribute this software", 5, 0.97),
    ("wtfpl", "want", r"(?:you just )?do what the \S+ you want to(?: public license)?", 4, 0.9),
    ("zlib", "liable", r"without any express or implied warranty in no event will the authors? be held liable for any damages arising from the use of this software", 5, 0.95),
    ("zlib", "misrepresented", r"the origin of this (?:software|source code) must not be misrepresented you must not claim that you wrote the original software", 5, 0.98),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented", 5, 0.97),
    ("libpng", "libpng", r"this copy of the libpng notices is provided for your convenience", 5, 0.98),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group", 5, 0.97),
    ("bzip2", "bzip2", r"this program bzip2 the associated library libbzip2 and all documentation", 5, 0.97),
    ("ftl", "freetype", r"(?:the )?freetype project license", 4, 0.9),
    ("ftl", "freetype", r"portions of this software are copyright (?:c |© )?(?:\S+ ){1,6}the freetype project", 5, 0.95),
    ("openssl", "openssl", r"this product includes software developed by the openssl project", 5, 0.97),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young", 5, 0.97),
    ("sleepycat", "accompanied", r"redistributions in any form must be accompanied by information on how to obtain complete source code", 5, 0.97),
    ("python-2.0", "psf", r"this license agreement is between the python software foundation psf and the individual or organization", 5, 0.98),
    ("python-2.0", "psf", r"psf license agreement for python", 5, 0.97),
    ("cnri-python", "cnri", r"cnri (?:open source )?license agreement", 5, 0.95),
    ("beopen-python", "beopen", r"beopen python open source license agreement", 5, 0.97),
    ("php-3.01", "php", r"this product includes php software freely available from", 5, 0.97),
    ("ruby", "verbatim", r"you may make and give away verbatim copies of the source form of the software without restriction", 5, 0.97),
    ("tcl", "authors", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", 5, 0.97),
    ("vim", "charityware", r"vim is charityware", 5, 0.95),
    ("beerware", "stuff", r"as long as you retain this notice you can do whatever you want with this stuff", 5, 0.97),
    ("json", "evil", r"the software shall be used for good not evil", 5, 0.98),
    ("fair", "instrument", r"usage of the works is permitted provided that this instrument is retained with the works", 5, 0.97),
    ("icu", "icu", r"icu license icu 1 8 1 and later", 5, 0.97),
    ("unicode", "unicode", r"unicode (?:inc )?license agreement data files and software", 5, 0.97),
    ("unicode", "unicode", r"unicode license v ?3", 4, 0.9),
    ("w3c", "w3c", r"w3c (?:software|document|ipr software) (?:and document )?(?:notice and )?license", 5, 0.95),
    ("w3c", "obtaining", r"this work is being provided by the copyright holders under the following license by obtaining", 5, 0.95),
    ("ofl-1.1", "sil", r"this font software is licensed under the sil open font license version 1 1", 5, 0.99),
    ("ofl-1.1", "sil", r"sil open font license version 1 1 26 february 2007", 5, 0.99),
    ("ofl-1.1", "reserved", r"with reserved font names?", 4, 0.9),
    ("cc0-1.0", "universal", r"cc0 1 0 universal", 5, 0.98),
    ("cc0-1.0", "deed", r"the person who associated a work with this deed has dedicated the work to the public domain", 5, 0.98),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero(?: 1 0)?", 5, 0.98),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark(?: 1 0)?", 5, 0.95),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd(?: \d \d)?", 5, 0.98),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa(?: \d \d)?", 5, 0.98),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc(?: \d \d)?", 4, 0.97),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd(?: \d \d)?", 5, 0.98),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa(?: \d \d)?", 5, 0.98),
    ("cc-by", "creativecommons", r"creativecommons org licenses by(?: \d \d)?", 3, 0.95),
    ("cc-by-nc-nd", "international", r"attribution non ?commercial no ?derivatives 4 0 international", 5, 0.97),
    ("cc-by-nc-sa", "international", r"attribution non ?commercial share ?alike 4 0 international", 5, 0.97),
    ("cc-by-nc", "international", r"attribution non ?commercial 4 0 international", 5, 0.97),
    ("cc-by-nd", "international", r"attribution no ?derivatives 4 0 international", 5, 0.97),
    ("cc-by-sa", "international", r"attribution share ?alike 4 0 international", 5, 0.97),
    ("cc-by", "international", r"attribution 4 0 international", 5, 0.97),
    ("cc", "sampling", r"creative commons sampling plus", 4, 0.9),
    ("odbl-1.0", "database", r"(?:this|the) (?:\S+ )?database is made available under the open database license", 5, 0.98),
    ("dbcl-1.0", "contents", r"individual contents of the database are licensed under the database contents license", 5, 0.98),
    ("odc-by", "attribution", r"open data commons attribution license", 4, 0.95),
    ("pddl", "dedication", r"open data commons public domain dedication(?: and)? licen[cs]e", 5, 0.97),
    ("cdla-permissive", "community", r"community data license agreement permissive(?: version [12] 0)?", 5, 0.97),
    ("cdla-sharing", "community", r"community data license agreement sharing(?: version 1 0)?", 5, 0.97),
    ("ogl-uk", "government", r"open government licen[cs]e(?: v ?\d 0)?", 4, 0.93),
    ("etalab", "ouverte", r"licence ouverte(?: open licence)?", 4, 0.9),
    ("ms-pl", "accompanying", r"this license governs use of the accompanying software if you use the software you accept this license", 5, 0.9),
    ("ms-eula", "microsoft", r"microsoft software license terms", 5, 0.95),
    ("afl-3.0", "academic", r"licensed under the academic free license version \d \d", 5, 0.98),
    ("osl-3.0", "open", r"licensed under the open software license version \d \d", 5, 0.98),
    ("busl-1.1", "business", r"business source license 1 1 parameters licensor", 5, 0.98),
    ("busl-1.1", "production", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", 5, 0.98),
    ("sspl-1.0", "server", r"server side public license version 1 october 16 2018", 5, 0.99),
    ("sspl-1.0", "service", r"make the functionality of the program or a modified version available to third parties as a service", 5, 0.97),
    ("elastic-2.0", "elastic", r"elastic license (?:v ?)?2 0", 5, 0.95),
    ("elastic-2.0", "managed", r"you may not provide the software to third parties as a hosted or managed service", 5, 0.97),
    ("commons-clause", "clause", r"commons clause license condition", 5, 0.98),
    ("commons-clause", "sell", r"the license does not grant to you the right to sell the software", 5, 0.95),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|perimeter|strict|free trial|internal use) license", 5, 0.97),
    ("prosperity", "prosperity", r"prosperity public license", 4, 0.93),
    ("parity", "parity", r"parity public license", 4, 0.93),
    ("blueoak-1.0.0", "oak", r"blue oak model license", 4, 0.95),
    ("upl-1.0", "permissive", r"universal permissive license(?: upl)?", 4, 0.95),
    ("mulanpsl-2.0", "mulan", r"mulan (?:psl|permissive software license)(?: version 2| v ?2)?", 4, 0.95),
    ("hippocratic", "hippocratic", r"hippocratic license(?: version)?", 4, 0.93),
    ("openrail", "openrail", r"(?:creative ml |bigscience |big code )?openrail m?(?: license)?", 4, 0.9),
    ("llama", "llama", r"llama (?:\d )?(?:\d )?community license agreement", 5, 0.95),
    ("qpl-1.0", "q", r"the q public license version 1 0", 5, 0.97),
    ("sissl", "industry", r"sun industry standards source license", 5, 0.97),
    ("spl-1.0", "sun", r"sun public license(?: version 1 0)?", 4, 0.93),
    ("rpl-1.5", "reciprocal", r"reciprocal public license(?: version)? 1 [15]", 5, 0.95),
    ("nasa-1.3", "nasa", r"nasa open source agreement(?: version 1 3)?", 5, 0.95),
    ("efl-2.0", "eiffel", r"eiffel forum license(?: version 2)?", 4, 0.95),
    ("lppl", "latex", r"latex project public license(?: version 1 \d)?", 4, 0.95),
    ("lppl", "latex", r"this work may be distributed and or modified under the conditions of the latex project public license", 5, 0.98),
    ("cecill", "cecill", r"cecill free software license agreement", 5, 0.97),
    ("cecill", "cecill", r"ce logiciel est régi par la licence cecill", 5, 0.97),
    ("cecill", "cecill", r"this software is governed by the cecill (?:[bc] )?license under french law", 5, 0.98),
    ("intel", "intel", r"intel (?:open|simplified) (?:source|software) license", 4, 0.93),
    ("public-domain", "domain", r"(?:released|dedicated|placed|donated) (?:in)?to the public domain", 4, 0.9),
    ("public-domain", "domain", r"(?:is|are) (?:hereby )?(?:in|within) the public domain", 4, 0.85),
    ("public-domain", "disclaims", r"the authors? disclaims? copyright to this source code", 5, 0.97),
    ("proprietary", "proprietary", r"proprietary and confidential|confidential and proprietary information of", 4, 0.8),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|use|distribution) of (?:this|these|any)", 3, 0.7),
    ("proprietary", "reproduced", r"no part of this (?:publication|book|document|work|website) may be reproduced", 4, 0.8),
    ("proprietary", "eula", r"end user license agreement eula", 4, 0.8),
    ("proprietary", "agreement", r"end user licen[cs]e agreement", 3, 0.7),
    ("non-commercial", "commercial", r"for (?:personal and )?non ?commercial (?:use|purposes) only", 3, 0.7),
    ("all-rights-reserved", "reserved", r"all rights reserved", 2, 0.5),
    ("all-rights-reserved", "vorbehalten", r"alle rechte vorbehalten", 2, 0.5),
    ("all-rights-reserved", "réservés", r"tous droits réservés", 2, 0.5),
    ("all-rights-reserved", "reservados", r"todos los derechos reservados", 2, 0.5),
    ("copyright", "copyright", r"copyright (?:c |© )?(?:19|20)\d\d", 1, 0.4),
    ("copyright", "©", r"© (?:19|20)\d\d", 1, 0.4),
]


class Rule(NamedTuple):
    label: str
    needs: tuple[str, ...]
    pattern: re.Pattern
    priority: int
    confidence: float


def made_rules() -> list[Rule]:
    """All rules, the most specific form first."""
    cited = [(f, IDENTIFIERS) for f in (*(f for f in FORMS if f[0] in CITED), JOINED)]
    named = [(f, LICENSES) for f in FORMS]
    out = [
        Rule(label, (word, *([other] if other else [])), re.compile(f" {before}(?:{name}){after}(?= )"), priority, confidence)
        for (_, before, after, priority, confidence, other), names in cited + named for label, word, name in names
    ]
    return out + [Rule(label, (word,), re.compile(f" (?:{text})(?= )"), priority, confidence) for label, word, text, priority, confidence in TEXTS]


RULES = made_rules()
#: By the word, in bytes, that a text must hold before a rule is looked at.
GATE: dict[bytes, list[int]] = {}
for _k, _r in enumerate(RULES):
    GATE.setdefault(_r.needs[0].encode(), []).append(_k)
GATE_KEYS = frozenset(GATE)
NOT_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of digits, letters and anything outside ASCII, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(NOT_WORD).split()


Detection = tuple[int, int, int, float, str, int]  # start, end, priority, confidence, label, rule


def left_over(found: list[Detection]) -> list[Detection]:
    """Those that no other of at least their priority holds inside it. By falling priority: one is inside an earlier start's
    interval if the farthest end among the starts up to its own is not before its own end."""
    out: list[Detection] = []
    starts: list[int] = []
    farthest: list[int] = []
    for priority in sorted({d[2] for d in found}, reverse=True):
        end = -1
        kept = []
        for d in sorted((d for d in found if d[2] == priority), key=lambda d: (d[0], -d[1], d[5])):
            i = bisect_right(starts, d[0])
            if d[1] > end and not (i and farthest[i - 1] >= d[1]):
                kept.append(d)
                end = d[1]
        out += kept
        marks = sorted((d[0], d[1]) for d in out)
        starts, farthest = [a for a, _ in marks], list(accumulate((b for _, b in marks), max))
    return sorted(out)


def own_start(m: re.Match) -> int:
    return m.start("own") if "own" in m.re.groupindex else m.start()


def detections(words: list[bytes], present: set[bytes]) -> list[Detection]:
    plain = b" ".join(words).decode("utf-8", "surrogatepass")
    line = " " + plain + " "
    begins: list[int] = []
    found = []
    for k in sorted(k for w in present & GATE_KEYS for k in GATE[w]):
        r = RULES[k]
        if len(r.needs) == 1 or r.needs[1].encode() in present:
            for m in r.pattern.finditer(line):
                begins = begins or [1, *(x.start() + 2 for x in re.finditer(" ", plain))]
                at = own_start(m)
                start = bisect_left(begins, at + 1)
                found.append((start, start + line.count(" ", at, m.end()), r.priority, r.confidence, r.label, k))
    return left_over(found)


PHRASES = [(b" " + p.encode() + b" ", p.split()[0].encode(), p.encode().split()[-1], label) for p, label in BASE.items()]


def scanned(text: str | None) -> dict:
    words = words_of(text or "")
    present = set(words)
    places: list[int] = []
    labels: set[str] = set()
    line = b""
    for phrase, first, last, label in PHRASES:
        if first in present and last in present:
            line = line or b" " + b" ".join(words) + b" "
            counted = before = 0
            at = line.find(phrase)
            while at >= 0:
                before += line.count(b" ", counted, at)
                counted = at
                places.append(before)
                labels.add(label)
                at = line.find(phrase, at + 1)
    hits = detections(words, present) if not present.isdisjoint(GATE_KEYS) else []
    score = max([0.6 * bool(places), *(h[3] for h in hits)])
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {h[4] for h in hits})), "score": float(score), "n_detections": len(hits),
    }


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_detections", pa.int64())])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scanned(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[f.name] for r in rows], f.type) for f in list(SCHEMA)[1:])], schema=SCHEMA)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long")
