"""Operator 9: license detection by ordered signature rules, in Spark SQL functions only.

Some 260 hand-written patterns (license names, each in several frames, and phrases of license texts) make the rules, in
order. Each document is tested for a few words of which every match has one; only documents that pass are normalised to
lower-case words between single spaces. There, rules are matched whose own keyword stands at the start of a word; every
match is a span with a priority. Spans are swept from left to right, longest first, and a span that lies in any span kept
before is suppressed unless its priority is higher.

Null and empty texts have no words, places or labels. Repeated rows give repeated results, ties between rules go to the
earlier rule, and extra columns of the input are ignored. Very long texts are matched whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sheltered

#: Characters that separate words, the base phrases and their labels.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
CASED_SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # what separates words before A-Z are lower-cased
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, SPDX identifier as words, name as a pattern over normalised words, keywords parted by |: each alternative of the name has one.
LICENSES = (
    ("mit", "mit", r"(?:mit|expat) licen[cs]e", "mit licen|expat licen"),
    ("mit-0", "mit 0", r"mit (?:no attribution|0) licen[cs]e", "mit no|mit 0"),
    ("apache-2", "apache 2 0", r"apache (?:software )?licen[cs]e (?:version )?v?2(?: 0)?", "apache"),
    ("apache-1.1", "apache 1 1", r"apache (?:software )?licen[cs]e (?:version )?v?1 1", "apache"),
    ("gpl-3", "gpl 3 0(?: only| or later)?", r"(?:gnu )?general public licen[cs]e (?:version |v)3(?: 0)?", "general public"),
    ("gpl-2", "gpl 2 0(?: only| or later)?", r"(?:gnu )?general public licen[cs]e (?:version |v)2(?: 0)?", "general public"),
    ("gpl", "gpl", r"gnu general public licen[cs]e", "general public"),
    ("agpl-3", "agpl 3 0(?: only| or later)?", r"(?:gnu )?affero general public licen[cs]e(?: (?:version |v)3(?: 0)?)?", "affero"),
    ("lgpl-3", "lgpl 3 0(?: only| or later)?", r"(?:gnu )?lesser general public licen[cs]e (?:version |v)3(?: 0)?", "lesser"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", r"(?:gnu )?lesser general public licen[cs]e (?:version |v)2 1", "lesser"),
    ("lgpl-2", "lgpl 2 0(?: only| or later)?", r"(?:gnu )?library general public licen[cs]e", "library"),
    ("lgpl", "lgpl", r"gnu lesser general public licen[cs]e", "lesser"),
    ("fdl-1.3", "gfdl 1 3", r"(?:gnu )?free documentation licen[cs]e(?: version 1 \d)?", "documentation"),
    ("bsd-2", "bsd 2 clause", r"(?:bsd 2 clause|simplified bsd|freebsd) licen[cs]e", "bsd|simplified bsd|freebsd"),
    ("bsd-3", "bsd 3 clause", r"(?:bsd 3 clause|new bsd|modified bsd|revised bsd) licen[cs]e", "bsd"),
    ("bsd-4", "bsd 4 clause", r"(?:bsd 4 clause|original bsd) licen[cs]e", "bsd"),
    ("bsd-0", "0bsd", r"(?:zero clause bsd|0bsd|bsd zero clause) licen[cs]e", "bsd|0bsd|zero clause"),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", "bsd"),
    ("mpl-2", "mpl 2 0", r"mozilla public licen[cs]e (?:version |v)?2(?: 0)?", "mozilla"),
    ("mpl-1.1", "mpl 1 1", r"mozilla public licen[cs]e (?:version |v)?1 1", "mozilla"),
    ("epl-2", "epl 2 0", r"eclipse public licen[cs]e (?:version |v)?2(?: 0)?", "eclipse"),
    ("epl-1", "epl 1 0", r"eclipse public licen[cs]e (?:version |v)?1(?: 0)?", "eclipse"),
    ("cddl-1", "cddl 1 0", r"common development and distribution licen[cs]e(?: version 1 \d)?", "common development"),
    ("isc", "isc", r"isc licen[cs]e", "isc"),
    ("zlib", "zlib", r"(?:zlib|zlib libpng) licen[cs]e", "zlib"),
    ("unlicense", "unlicense", r"the unlicen[cs]e", "unlicen"),
    ("wtfpl", "wtfpl", r"do what the (?:f\w+|hell) you want to public licen[cs]e", "do what the"),
    ("artistic-2", "artistic 2 0", r"artistic licen[cs]e (?:version )?2(?: 0)?", "artistic"),
    ("artistic-1", "artistic 1 0", r"artistic licen[cs]e (?:version )?1(?: 0)?", "artistic"),
    ("boost-1", "bsl 1 0", r"boost software licen[cs]e(?: version 1(?: 0)?)?", "boost"),
    ("python-2", "python 2 0", r"(?:python software foundation|psf) licen[cs]e(?: (?:version )?2(?: 0)?)?", "software foundation|psf"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("ofl-1.1", "ofl 1 1", r"(?:sil )?open font licen[cs]e(?: (?:version )?1 1)?", "open font"),
    ("eupl-1.2", "eupl 1 2", r"european union public licen[cs]e(?: (?:version |v)?1 \d)?", "european union"),
    ("osl-3", "osl 3 0", r"open software licen[cs]e(?: (?:version |v)?3(?: 0)?)?", "open software"),
    ("ms-pl", "ms pl", r"microsoft public licen[cs]e", "microsoft"),
    ("ms-rl", "ms rl", r"microsoft reciprocal licen[cs]e", "microsoft"),
    ("cc0-1", "cc0 1 0", r"(?:creative commons zero|cc0)(?: (?:version )?1 0)?(?: universal)?", "cc0|commons zero"),
    ("cc-by-4", "cc by 4 0", r"(?:creative commons attribution|cc by)(?: (?:international|licen[cs]e))* 4(?: 0)?", "commons attribution|cc by"),
    ("cc-by-3", "cc by 3 0", r"(?:creative commons attribution|cc by)(?: (?:unported|licen[cs]e))* 3(?: 0)?", "commons attribution|cc by"),
    ("cc-by-sa", "cc by sa \\d 0", r"(?:creative commons attribution share ?alike|cc by sa)(?: \d(?: 0)?)?", "cc by sa|commons attribution"),
    ("cc-by-nd", "cc by nd \\d 0", r"(?:creative commons attribution no ?deriv\w*|cc by nd)(?: \d(?: 0)?)?", "cc by nd|commons attribution"),
    ("cc-by-nc-4", "cc by nc 4 0", r"(?:creative commons attribution non ?commercial|cc by nc) 4(?: 0)?", "cc by nc|commons attribution"),
    ("cc-by-nc-sa", "cc by nc sa \\d 0", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: \d(?: 0)?)?", "cc by nc sa|commons attribution"),
    ("cc-by-nc-nd", "cc by nc nd \\d 0", r"(?:creative commons attribution non ?commercial no ?deriv\w*|cc by nc nd)(?: \d(?: 0)?)?", "cc by nc nd|commons attribution"),
    ("odbl-1", "odbl 1 0", r"open (?:data commons open )?database licen[cs]e(?: (?:version |v)?1(?: 0)?)?", "database"),
)

#: pattern with {name} or {id}, priority, confidence.
FRAMES = (
    (r"(?:this|these|the) (?:\w+ ){1,4}(?:is|are) (?:licensed|released|distributed|made available|provided|published) under (?:the )?(?:terms of )?(?:the )?{name}", 90, 0.98),
    (r"(?:licensed|released|distributed|made available|provided|published) under (?:the )?(?:terms of )?(?:the )?{name}", 85, 0.95),
    (r"spdx licen[cs]e identifier {id}", 95, 1.0),
    (r"(?:subject to|according to|in accordance with|governed by|under) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}", 75, 0.85),
    (r"(?:see|read|copy of) (?:the )?{name}", 65, 0.7),
    (r"{name}", 50, 0.5),
)

#: Signatures of license texts themselves: label, pattern, keyword, priority, confidence.
TEXTS = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby granted", 88, 0.97),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission to use", 88, 0.97),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", "redistribution", 86, 0.95),
    ("bsd-3", r"neither the name of (?:\w+ ){1,12}may be used to endorse or promote", "neither the name", 89, 0.96),
    ("bsd-4", r"all advertising materials mentioning features or use of this software", "advertising materials", 89, 0.96),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies", "verbatim copies", 84, 0.9),
    ("gpl", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "redistribute it", 91, 0.97),
    ("gpl-3", r"either version 3 of the licen[cs]e or (?:at your option )?any later version", "either version 3", 92, 0.97),
    ("gpl-2", r"either version 2 of the licen[cs]e or (?:at your option )?any later version", "either version 2", 92, 0.97),
    ("lgpl", r"under the terms of the gnu lesser general public licen[cs]e", "lesser", 91, 0.97),
    ("agpl-3", r"under the terms of the gnu affero general public licen[cs]e", "affero", 91, 0.97),
    ("apache-2", r"you may not use this file except in compliance with the licen[cs]e", "in compliance", 87, 0.95),
    ("apache-2", r"apache org licenses licen[cs]e 2 0", "apache org", 93, 0.99),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public licen[cs]e", "source code form", 93, 0.99),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 93, 0.99),
    ("zlib", r"altered source versions must be plainly marked as such", "plainly marked", 88, 0.96),
    ("boost-1", r"boost org licen[cs]e 1 0 txt", "boost org", 93, 0.99),
    ("cc-by-sa", r"creativecommons org licenses by sa", "creativecommons", 93, 0.99),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa", "creativecommons", 94, 0.99),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd", "creativecommons", 94, 0.99),
    ("cc-by-nc", r"creativecommons org licenses by nc", "creativecommons", 92, 0.98),
    ("cc-by-nd", r"creativecommons org licenses by nd", "creativecommons", 93, 0.98),
    ("cc0-1", r"creativecommons org publicdomain zero", "creativecommons", 93, 0.99),
    ("public-domain", r"(?:dedicated|released|placed|in) (?:to |into |in )?the public domain", "public domain", 70, 0.8),
    ("proprietary", r"all rights reserved", "rights reserved", 40, 0.4),
    ("proprietary", r"(?:confidential and proprietary|proprietary and confidential)", "proprietary", 60, 0.7),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "permission notice shall", 88, 0.96),
    ("mit", r"to deal in the software without restriction including without limitation the rights", "deal in the", 88, 0.97),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", "authors or copyright", 82, 0.9),
    ("mit-0", r"permission is hereby granted .{0,220}without restriction .{0,260}to whom the software is furnished to do so the software is provided", "hereby granted", 90, 0.95),
    ("x11", r"x11 licen[cs]e", "x11", 70, 0.9),
    ("x11", r"except as contained in this notice the name of .{1,60}shall not be used in advertising", "except as contained", 89, 0.96),
    ("isc", r"provided that the above copyright notice and this permission notice appear in all copies", "appear in all", 87, 0.95),
    ("isc", r"the software is provided as is and the author disclaims all warranties", "author disclaims", 86, 0.95),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee", "documentation for any", 90, 0.97),
    ("ntp", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee", "documentation for any", 89, 0.95),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions of", 86, 0.95),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in", 86, 0.95),
    ("bsd", r"this list of conditions and the following disclaimer", "list of conditions", 84, 0.93),
    ("bsd", r"this software is provided by the (?:copyright holders?|regents|authors?) and contributors as is", "contributors as is", 85, 0.95),
    ("bsd-4", r"this product includes software developed by", "product includes software", 87, 0.9),
    ("bsd-2", r"the views and conclusions contained in the software and documentation are those of the authors", "views and conclusions", 88, 0.95),
    ("bsd-protection", r"bsd protection licen[cs]e", "bsd protection", 80, 0.95),
    ("bsd-patent", r"bsd 2 clause plus patent", "clause plus patent", 82, 0.95),
    ("gpl", r"this program is free software", "is free software", 83, 0.85),
    ("gpl", r"gnu general public licen[cs]e as published by the free software foundation", "general public", 90, 0.97),
    ("gpl", r"you should have received a copy of the gnu general public licen[cs]e", "general public", 90, 0.97),
    ("gpl", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom", "take away your", 92, 0.98),
    ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose", "even the implied", 78, 0.7),
    ("gpl", r"(?:51 franklin street fifth floor|59 temple place suite 330|675 mass ave cambridge)", "franklin street|temple place|675 mass", 72, 0.75),
    ("gpl", r"gnu org licenses", "gnu org", 80, 0.85),
    ("gpl-2", r"(?:gnu )?gpl ?v ?2(?: 0)?", "gpl v2|gplv2|gpl v 2|gplv 2", 85, 0.92),
    ("gpl-3", r"(?:gnu )?gpl ?v ?3(?: 0)?", "gpl v3|gplv3|gpl v 3|gplv 3", 85, 0.92),
    ("gpl-2", r"gnu org licenses (?:old licenses )?gpl 2 0", "gnu org", 91, 0.97),
    ("gpl-3", r"gnu org licenses gpl 3 0", "gnu org", 91, 0.97),
    ("gpl", r"gnu gpl", "gnu gpl", 70, 0.8),
    ("gpl-classpath", r"as a special exception the copyright holders of this library give you permission to link this library", "special exception", 93, 0.97),
    ("gpl-classpath", r"classpath exception", "classpath exception", 90, 0.95),
    ("lgpl", r"this library is free software", "library is free", 86, 0.92),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", "general public", 92, 0.97),
    ("lgpl", r"gnu lgpl", "gnu lgpl", 72, 0.85),
    ("lgpl-2.1", r"(?:gnu )?lgpl ?v ?2 1", "lgpl v2|lgplv2|lgpl v 2|lgplv 2", 86, 0.93),
    ("lgpl-3", r"(?:gnu )?lgpl ?v ?3", "lgpl v3|lgplv3|lgpl v 3|lgplv 3", 86, 0.93),
    ("agpl-3", r"(?:gnu )?agpl ?v ?3", "agpl v3|agplv3|agpl v 3|agplv 3", 87, 0.94),
    ("agpl-3", r"remote network interaction use with the gnu general public licen[cs]e", "remote network", 94, 0.98),
    ("gnu-all-permissive", r"copying and distribution of this file with or without modification are permitted in any medium", "copying and distribution", 92, 0.97),
    ("gnu-verbatim", r"verbatim copying and distribution of this entire (?:article|page|document) (?:is|are) permitted", "verbatim copying", 90, 0.95),
    ("fdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", "documentation", 94, 0.98),
    ("fdl", r"with no invariant sections", "invariant sections", 88, 0.9),
    ("apache-2", r"licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements", "apache software", 94, 0.99),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis", "applicable law", 88, 0.95),
    ("apache-2", r"see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e", "specific language", 88, 0.95),
    ("apache-2", r"apache licen[cs]e version 2 0 january 2004", "january 2004", 95, 1.0),
    ("apache-2", r"apache (?:2 0|2|v2) licen[cs]ed?", "apache 2|apache v2", 75, 0.9),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "apache software", 93, 0.95),
    ("apache-1", r"this product includes software developed by the apache group", "apache group", 93, 0.95),
    ("mpl-2", r"if a copy of the mpl was not distributed with this file", "the mpl", 94, 0.99),
    ("mpl-2", r"mozilla org mpl 2 0", "mozilla org", 93, 0.99),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1", "mozilla public", 95, 0.99),
    ("mpl-1", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 0", "mozilla public", 95, 0.99),
    ("mpl-2", r"incompatible with secondary licenses", "secondary licenses", 90, 0.95),
    ("npl", r"netscape public licen[cs]e", "netscape public", 80, 0.95),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", "accompanying materials", 94, 0.99),
    ("epl", r"eclipse org legal epl", "eclipse org", 92, 0.97),
    ("edl", r"eclipse distribution licen[cs]e", "eclipse distribution", 82, 0.95),
    ("cpl", r"common public licen[cs]e(?: version 1 0| v1 0)?", "common public", 78, 0.92),
    ("ipl", r"ibm public licen[cs]e", "ibm public", 80, 0.95),
    ("spl", r"sun public licen[cs]e", "sun public", 80, 0.95),
    ("sissl", r"sun industry standards source licen[cs]e", "sun industry", 82, 0.96),
    ("cddl", r"cddl header start", "cddl header", 93, 0.99),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "common development", 94, 0.99),
    ("cddl", r"cddl (?:version )?v?1 [01]", "cddl", 80, 0.92),
    ("cc-by-4", r"creativecommons org licenses by 4 0", "creativecommons org", 95, 1.0),
    ("cc-by-3", r"creativecommons org licenses by 3 0", "creativecommons org", 95, 1.0),
    ("cc-by-2", r"creativecommons org licenses by 2 [05]", "creativecommons org", 95, 1.0),
    ("cc-by-sa-4", r"creativecommons org licenses by sa 4 0", "creativecommons org", 96, 1.0),
    ("cc-by-sa-3", r"creativecommons org licenses by sa 3 0", "creativecommons org", 96, 1.0),
    ("cc-by-nc-4", r"creativecommons org licenses by nc 4 0", "creativecommons org", 96, 1.0),
    ("cc-by-nc-sa-4", r"creativecommons org licenses by nc sa 4 0", "creativecommons org", 97, 1.0),
    ("cc-by-nc-nd-4", r"creativecommons org licenses by nc nd 4 0", "creativecommons org", 97, 1.0),
    ("cc-pd-mark", r"creativecommons org publicdomain mark", "creativecommons org", 95, 0.99),
    ("cc", r"you are free to share copy and redistribute the material in any medium or format", "copy and redistribute", 86, 0.93),
    ("cc", r"you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made", "appropriate credit", 86, 0.93),
    ("cc-by-nc", r"you may not use the material for commercial purposes", "material for commercial", 87, 0.93),
    ("cc-by-sa", r"if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e", "build upon the", 88, 0.95),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material", "build upon the", 88, 0.95),
    ("cc", r"creative commons (?:public )?licen[cs]es?", "creative commons", 60, 0.75),
    ("cc", r"some rights reserved", "some rights", 55, 0.6),
    ("cc-sampling", r"creative commons sampling(?: plus)?", "commons sampling", 80, 0.93),
    ("cc-devnations", r"creative commons developing nations", "developing nations", 80, 0.93),
    ("cc0-1", r"to the extent possible under law .{1,120} waived all copyright and related or neighboring rights", "waived all", 93, 0.98),
    ("cc0-1", r"no copyright reserved", "no copyright", 70, 0.7),
    ("public-domain", r"this (?:work|file|software|code|document) is (?:hereby )?(?:released |placed )?in(?:to)? the public domain", "public domain", 88, 0.93),
    ("public-domain", r"has been (?:dedicated|released|identified as being free of known restrictions)(?: .{1,80})? (?:in |into |to )?(?:the )?public domain", "public domain", 82, 0.85),
    ("public-domain", r"public domain mark", "public domain", 75, 0.85),
    ("public-domain", r"not (?:subject to|protected by) copyright", "to copyright|by copyright", 68, 0.7),
    ("public-domain", r"work of the (?:united states|u s) government", "states government|s government", 74, 0.85),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free", 93, 0.99),
    ("unlicense", r"unlicense org", "unlicense org", 90, 0.97),
    ("wtfpl", r"wtfpl", "wtfpl", 70, 0.85),
    ("zlib", r"the origin of this software must not be misrepresented", "origin of this", 89, 0.96),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "be held liable", 89, 0.96),
    ("libpng", r"libpng licen[cs]e", "libpng", 78, 0.93),
    ("libpng", r"the png reference library is supplied as is", "png reference", 92, 0.97),
    ("boost-1", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "person or organization", 94, 0.99),
    ("boost-1", r"distributed under the boost software licen[cs]e", "boost software", 90, 0.98),
    ("ofl-1.1", r"reserved font name", "reserved font", 86, 0.93),
    ("ofl-1.1", r"scripts sil org ofl", "sil org", 92, 0.98),
    ("ofl-1.1", r"the fonts and derivatives however cannot be released under any other type of licen[cs]e", "fonts and derivatives", 93, 0.98),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", "package may be", 93, 0.98),
    ("artistic", r"artistic licen[cs]e", "artistic", 60, 0.75),
    ("perl", r"under the same terms as perl(?: itself| \d)?", "as perl", 88, 0.96),
    ("clarified-artistic", r"clarified artistic licen[cs]e", "clarified artistic", 80, 0.95),
    ("python-2", r"psf is making python available to licensee on an as is basis", "psf is making", 94, 0.99),
    ("python-beopen", r"beopen python (?:open source )?licen[cs]e", "beopen python", 86, 0.96),
    ("python-cnri", r"cnri (?:open source )?licen[cs]e agreement", "cnri", 86, 0.96),
    ("eupl", r"licensed under the eupl", "the eupl", 88, 0.95),
    ("eupl", r"joinup ec europa eu (?:\w+ ){0,4}eupl", "joinup ec", 90, 0.95),
    ("odbl-1", r"opendatacommons org licenses odbl", "opendatacommons org", 93, 0.99),
    ("odc-by", r"opendatacommons org licenses by", "opendatacommons org", 93, 0.99),
    ("odc-by", r"open data commons attribution licen[cs]e", "data commons", 86, 0.97),
    ("pddl", r"opendatacommons org licenses pddl", "opendatacommons org", 93, 0.99),
    ("pddl", r"(?:open data commons )?public domain dedication and licen[cs]e", "domain dedication", 86, 0.95),
    ("cdla-permissive", r"community data licen[cs]e agreement permissive", "community data", 86, 0.97),
    ("cdla-sharing", r"community data licen[cs]e agreement sharing", "community data", 86, 0.97),
    ("ogl-uk", r"open government licen[cs]e", "open government", 80, 0.93),
    ("ogl-uk", r"contains public sector information licensed under", "public sector", 88, 0.95),
    ("etalab", r"(?:licence ouverte|etalab open licen[cs]e)", "licence ouverte|etalab", 82, 0.93),
    ("dl-de-by", r"datenlizenz deutschland namensnennung", "datenlizenz", 84, 0.95),
    ("nlod", r"norwegian licen[cs]e for open government data", "norwegian", 84, 0.95),
    ("ms-pl", r"if you use the software you accept this licen[cs]e", "you accept this", 82, 0.85),
    ("ms-lpl", r"microsoft limited public licen[cs]e", "microsoft limited", 82, 0.95),
    ("afl-3", r"academic free licen[cs]e(?: (?:version |v)?3(?: 0)?)?", "academic free", 80, 0.93),
    ("ecl-2", r"educational community licen[cs]e(?: (?:version )?2(?: 0)?)?", "educational community", 80, 0.94),
    ("ncsa", r"university of illinois ncsa open source licen[cs]e", "illinois ncsa|illinois", 86, 0.97),
    ("qpl", r"(?:the )?q public licen[cs]e", "q public", 80, 0.94),
    ("qt-commercial", r"qt commercial licen[cs]e", "qt commercial", 82, 0.93),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code", "obtain complete", 93, 0.98),
    ("sleepycat", r"sleepycat licen[cs]e", "sleepycat", 80, 0.94),
    ("openssl", r"this product includes software developed by the openssl project", "openssl project", 93, 0.98),
    ("openssl", r"(?:openssl|ssleay) licen[cs]e", "openssl|ssleay", 80, 0.94),
    ("php-3", r"(?:the )?php licen[cs]e(?: (?:version |v)?3(?: 0\d?)?)?", "php licen", 80, 0.93),
    ("php-3", r"this product includes php software freely available from", "includes php", 93, 0.98),
    ("zpl", r"zope public licen[cs]e(?: zpl)?(?: (?:version )?\d(?: \d)?)?", "zope public", 80, 0.95),
    ("ruby", r"(?:the )?ruby licen[cs]e", "ruby licen", 76, 0.9),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction", "give away verbatim", 91, 0.95),
    ("beerware", r"the beer ?ware licen[cs]e", "beer ware|beerware", 86, 0.97),
    ("beerware", r"you can buy me a beer in return", "a beer", 90, 0.97),
    ("json", r"the software shall be used for good not evil", "good not evil", 95, 0.99),
    ("vim", r"vim licen[cs]e", "vim licen", 78, 0.92),
    ("w3c", r"w3c (?:software|document)(?: and document)? (?:notice and )?licen[cs]e", "w3c", 84, 0.96),
    ("unicode", r"unicode licen[cs]e agreement data files and software", "data files", 90, 0.97),
    ("unicode", r"unicode (?:terms of use|licen[cs]e v3)", "unicode", 78, 0.88),
    ("icu", r"icu licen[cs]e", "icu licen", 78, 0.92),
    ("curl", r"curl licen[cs]e", "curl licen", 78, 0.92),
    ("imagemagick", r"imagemagick licen[cs]e", "imagemagick", 80, 0.94),
    ("freetype", r"(?:the )?freetype (?:project )?licen[cs]e", "freetype", 80, 0.94),
    ("freetype", r"portions of this software are copyright .{1,40}the freetype project", "freetype project", 90, 0.96),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "independent jpeg", 93, 0.98),
    ("bzip2", r"bzip2 licen[cs]e", "bzip2", 78, 0.92),
    ("lppl", r"latex project public licen[cs]e(?: (?:version )?1 \d)?", "latex project", 84, 0.96),
    ("opl", r"open publication licen[cs]e", "open publication", 80, 0.93),
    ("opl", r"open content licen[cs]e", "open content", 76, 0.9),
    ("blueoak", r"blue oak model licen[cs]e", "blue oak", 82, 0.96),
    ("mulan", r"mulan (?:permissive software licen[cs]e|psl)(?: (?:version |v)?\d)?", "mulan", 82, 0.95),
    ("cecill", r"cecill(?: [abc])? (?:free software )?licen[cs]e", "cecill", 82, 0.95),
    ("upl", r"universal permissive licen[cs]e", "universal permissive", 82, 0.95),
    ("cpal", r"common public attribution licen[cs]e", "public attribution", 82, 0.95),
    ("rpl", r"reciprocal public licen[cs]e", "reciprocal public", 80, 0.94),
    ("osl", r"open software licen[cs]e", "open software", 58, 0.75),
    ("nosl", r"nasa open source agreement", "nasa open", 82, 0.95),
    ("busl-1.1", r"business source licen[cs]e(?: 1 1)?", "business source", 82, 0.95),
    ("busl-1.1", r"on the change date .{0,120}the licensor hereby grants you rights under the terms of the change licen[cs]e", "change date", 93, 0.98),
    ("sspl-1", r"server side public licen[cs]e", "server side", 84, 0.96),
    ("elastic-2", r"elastic licen[cs]e(?: (?:version |v)?2(?: 0)?)?", "elastic licen", 80, 0.94),
    ("commons-clause", r"commons clause(?: licen[cs]e condition)?", "commons clause", 84, 0.95),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter|internal use)(?: licen[cs]e)?", "polyform", 86, 0.97),
    ("hippocratic", r"hippocratic licen[cs]e", "hippocratic", 82, 0.96),
    ("anti-996", r"anti 996 licen[cs]e", "anti 996", 84, 0.97),
    ("llama", r"llama (?:\d )?community licen[cs]e", "llama", 84, 0.96),
    ("openrail", r"(?:creativeml |bigscience )?open ?rail(?: m| s)?(?: licen[cs]e)?", "openrail|open rail", 80, 0.92),
    ("responsible-ai", r"responsible ai licen[cs]e", "responsible ai", 80, 0.93),
    ("gemma", r"gemma terms of use", "gemma terms", 84, 0.95),
    ("proprietary", r"end user licen[cs]e agreement", "end user", 66, 0.8),
    ("proprietary", r"no part of this (?:publication|book|work|document) may be reproduced", "may be reproduced", 78, 0.85),
    ("proprietary", r"(?:reproduced|reprinted|used) (?:with|by) (?:kind )?permission", "with permission|by permission|kind permission", 58, 0.6),
    ("proprietary", r"unauthori[sz]ed (?:copying|reproduction|distribution|use) (?:\w+ ){0,8}(?:is )?(?:strictly )?prohibited", "prohibited", 76, 0.85),
    ("proprietary", r"(?:for )?internal use only", "internal use", 60, 0.65),
    ("proprietary", r"(?:this|the) (?:software|material|content) is (?:the )?(?:confidential|proprietary)", "confidential|proprietary", 74, 0.8),
    ("proprietary", r"trade secrets? of", "trade secret|trade secrets", 64, 0.7),
    ("proprietary", r"reverse engineer decompile or disassemble", "reverse engineer", 80, 0.88),
    ("noncommercial", r"(?:for )?(?:personal|private) (?:and )?(?:non ?commercial )?use only", "personal use only|private use only|personal and|private and|commercial use only|noncommercial use only", 62, 0.7),
    ("noncommercial", r"(?:for )?non ?commercial (?:use|purposes)(?: only)?", "commercial use|commercial purposes|noncommercial use|noncommercial purposes", 60, 0.7),
    ("noncommercial", r"(?:for )?(?:academic|research|educational) (?:use|purposes) only", "academic use|research use|educational use|academic purposes|research purposes|educational purposes", 66, 0.75),
    ("noncommercial", r"commercial use (?:is )?(?:strictly )?(?:prohibited|forbidden|not (?:allowed|permitted))", "commercial use", 78, 0.88),
)

@functools.cache
def rules() -> list[tuple[int, str, str, str, int, float]]:
    """(id, label, keywords parted by |, pattern, priority, confidence); the order settles ties."""
    made: list[tuple[str, str, str, int, float]] = []
    for label, spdx, name, keyword in LICENSES:
        for frame, priority, sure in FRAMES:
            uses_id = "{id}" in frame
            made.append((label, "spdx" if uses_id else keyword, frame.replace("{name}", name).replace("{id}", spdx), priority, sure))
    made += [(label, keyword, pattern, priority, sure) for label, pattern, keyword, priority, sure in TEXTS]
    return [(i, label, keyword, f" {pattern}(?= )", priority, sure) for i, (label, keyword, pattern, priority, sure) in enumerate(made)]


#: Words that are no anchors where another word serves: many texts have them, or longer words that hold them.
EVERYDAY = frozenset("a all and any anyone appear application are as attribution back be beer build by can code condition conditions contained content copies copy copying data deal developed documentation does either entire even except file for form free freely from good granted group has have held hereby hold in includes information internal is it just law library list made many material mass may must name national new nc nd no non not notice of on one only open or org origin other out own package part party person place product program project provided public purpose reference remove reserved return sa same science service share software some source special state states street subject supplied take temple terms that the them this to trade under upon use used want what which who with without work works written you your".split())


def _always(pattern: str) -> set[str]:
    """Words, or beginnings of words, in every match of a pattern: those outside its options and alternatives."""
    rest, before = pattern.replace("licen[cs]e", "licen "), ""
    while rest != before:
        before = rest
        rest = re.sub(r"\(\?[:=][^()]*\)[?*]|\(\?[:=][^()]*\|[^()]*\)(?:\{\d+,\d+\})?|\(\?:[^()]*\)\{\d+,\d+\}|\(\?= \)", " # ", rest)
        rest = re.sub(r"\(\?:([^()|]*)\)(?![?*{])", r"\1", rest)
    return {w for w in rest.split(" ") if re.fullmatch("[a-z0-9]{3,}", w)}


@functools.cache
def anchors() -> tuple[str, ...]:
    """Few words of which each match of a rule or phrase has one: a text without any of them, in lower case, has no match."""
    needs = [[_always(p)] if _always(p) - EVERYDAY else [set(k.split()) for k in some.split("|")] for _, _, some, p, *_ in rules()]
    needs = [n for rule in needs for n in rule] + [set(p.split()) for p, _ in PHRASES]
    needs = [n - EVERYDAY or {max(n, key=len)} for n in needs]
    chosen: list[str] = []
    while needs:
        words = sorted({w for n in needs for w in n})
        best = max(words, key=lambda w: (sum(any(w in x for x in n) for n in needs), len(w)))
        chosen.append(best)
        needs = [n for n in needs if not any(best in x for x in n)]
    return tuple(chosen)


def _rules_literal() -> Column:
    return F.array(*(F.struct(F.lit(i).alias("id"), F.lit(a).alias("label"), F.array(*(F.lit(f" {w}") for w in k.split("|"))).alias("keywords"), F.lit(p).alias("pattern"), F.lit(n).alias("priority"), F.lit(c).alias("sure")) for i, a, k, p, n, c in rules()))


#: Items that a fold appends to one array. Appending copies an array, so what is appended to stays as short as that.
CHUNK = 128


def _folded(items: Column, state: dict[str, Column], emitted: str, step: Callable[[Column, Column], Column]) -> Column:
    """The array that a fold emits, in time that grows with the number of items, not with its square.

    step(acc, item) gives the struct of the state and `out`, the chunk's own array of type `emitted`; chunks are put together once.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda i: F.slice(items, i * CHUNK + 1, F.lit(CHUNK)))
    own = lambda acc: [acc[n].alias(n) for n in state]
    empty = F.array().cast(emitted).alias("out")
    start = F.struct(*(c.alias(n) for n, c in state.items()), F.array().cast(f"array<{emitted}>").alias("outs"))

    def chunk(acc: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(*own(acc), empty), step)
        return F.transform(F.array(done), lambda d: F.struct(*own(d), F.concat(acc["outs"], F.array(d["out"])).alias("outs")))[0]

    return F.when(F.size(items) > 0, F.aggregate(chunks, start, chunk, lambda acc: F.flatten(acc["outs"]))).otherwise(F.array().cast(emitted))


def _spans(norm: Column, rule: Column) -> Column:
    """Every match of one rule as a struct; starts follow from the lengths of the pieces between the matches."""
    found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    gaps = F.when(F.size(found) > 0, F.split(norm, rule["pattern"], -1)).otherwise(F.array().cast("array<string>"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + pair["gap"]
        end = begin + pair["hit"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("stop")))).alias("out"))

    lengths = lambda texts: F.transform(texts, lambda t: F.length(t))
    pairs = F.zip_with(lengths(F.slice(gaps, 1, F.size(found))), lengths(found), lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    # pairs are used three times: held as the one element of an array, they are made once
    spans = F.transform(F.array(pairs), lambda held: _folded(held, {"at": F.lit(0)}, "array<struct<start:int,stop:int>>", step))[0]
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("negative_stop"), (-rule["priority"]).alias("negative_priority"), rule["id"].alias("rule"), rule["label"].alias("label"), rule["sure"].alias("sure")),
    )


def _swept(spans: Column) -> Column:
    """Spans in order of start, longest first; one inside a kept span needs a higher priority than that to stay.

    live holds the kept spans that can still suppress one: those that reach beyond the start, but for those inside another
    of at least their priority. There are no more of them than priorities.
    """
    kept_type = "array<struct<start:int,negative_stop:int,negative_priority:int,rule:int,label:string,sure:double>>"

    def step(acc: Column, s: Column) -> Column:
        over = lambda a, b: (a["negative_stop"] <= b["negative_stop"]) & (a["negative_priority"] <= b["negative_priority"])
        still = F.filter(acc["live"], lambda k: (-k["negative_stop"] > s["start"]) & ~over(s, k))
        own = F.array(F.struct(s["negative_stop"].alias("negative_stop"), s["negative_priority"].alias("negative_priority")))
        return F.when(F.exists(acc["live"], lambda k: over(k, s)), acc).otherwise(F.struct(F.concat(still, own).alias("live"), F.concat(acc["out"], F.array(s)).alias("out")))

    live = {"live": F.array().cast("array<struct<negative_stop:int,negative_priority:int>>")}
    return F.transform(F.array(F.array_sort(spans)), lambda held: _folded(held, live, kept_type, step))[0]


def _may_match(lower: Column) -> Column:
    found = F.lit(False)
    for word in anchors():
        found = found | F.contains(lower, F.lit(word))
    return found


def scan(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the kept columns, n_words, n_base, first_word, last_word, base_labels, labels, score and detections.

    detections is an array of (start, stop, priority, rule, label, sure); offsets count characters of the normalised
    text, in which every word follows one space.
    """
    sheltered(documents, text, *keep)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # a column of its own: within the conditions it would be computed again for every word
    rows = documents.select(*keep, body.alias("_body"), F.lower(body).alias("_low"))
    rows = rows.select(*keep, "_body", _may_match(F.col("_low")).alias("_gate"))
    # every run of separators becomes one space; then spaces count words
    rows = rows.select(*keep, "_gate", F.trim(F.regexp_replace("_body", f"[{CASED_SEPARATORS}]+", " ")).alias("_words"))
    n_words = F.when(F.col("_words") == "", F.lit(0)).otherwise(F.length("_words") - F.length(F.replace("_words", F.lit(" "), F.lit(""))) + 1)
    norm = F.concat(F.lit(" "), F.translate("_words", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(" "))
    norm = F.when(F.col("_words") == "", F.lit("  ")).otherwise(norm)
    rows = rows.select(*keep, n_words.cast("long").alias("n_words"), F.when(F.col("_gate"), norm).alias("_norm"))
    # words doubly spaced: each owns a space on either side, so that neighbouring places never share a character
    rows = rows.withColumn("_wide", F.concat(F.lit(" "), F.replace(F.substring("_norm", 2, 2147483647), F.lit(" "), F.lit("  "))))
    rows = rows.withColumn("_wide", F.expr("substring(_wide, 1, length(_wide) - 1)"))
    places, firsts, lasts, names = [], [], [], []
    for phrase, label in PHRASES:
        wide = " " + phrase.replace(" ", "  ") + " "
        lit = F.lit(wide)
        count = (F.length("_wide") - F.length(F.replace("_wide", lit, F.lit("")))) / len(wide)
        before = F.expr(f"substring(_wide, 1, instr(_wide, '{wide}') - 1)")
        after = F.expr(f"substring(reverse(_wide), 1, instr(reverse(_wide), '{wide[::-1]}') - 1)")
        half = lambda c: (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))) / 2
        there = F.contains("_wide", lit)
        places.append(F.when(there, count).otherwise(F.lit(0.0)))
        firsts.append(F.when(there, half(before)))
        lasts.append(F.when(there, F.col("n_words") - half(after) - len(phrase.split())))
        names.append(F.when(there, F.lit(label)))
    total = places[0]
    for p in places[1:]:
        total = total + p
    # each keyword is looked for once, whatever the number of its rules
    there = F.filter(F.array(*map(F.lit, sorted({f" {k}" for _, _, some, *_ in rules() for k in some.split("|")}))), lambda k: F.contains(F.col("_norm"), k))
    rows = rows.withColumn("_there", F.when(F.col("_norm").isNotNull(), there))
    candidates = F.filter(_rules_literal(), lambda r: F.arrays_overlap(r["keywords"], F.col("_there")))
    spans = F.flatten(F.transform(candidates, lambda r: _spans(F.col("_norm"), r)))
    rows = rows.select(
        *keep, "n_words",
        F.round(F.coalesce(total, F.lit(0.0))).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*names))).alias("_base"),
        F.when(F.col("_norm").isNotNull(), _swept(spans)).alias("_kept"),
    )
    out = "array<struct<start:int,stop:int,priority:int,rule:int,label:string,sure:double>>"
    detections = F.coalesce(F.transform("_kept", lambda s: F.struct(s["start"].alias("start"), (-s["negative_stop"]).alias("stop"), (-s["negative_priority"]).alias("priority"), s["rule"].alias("rule"), s["label"].alias("label"), s["sure"].alias("sure"))), F.array().cast(out))
    rows = rows.withColumn("detections", detections)
    best = F.coalesce(F.array_max(F.transform("detections", lambda d: d["sure"])), F.lit(0.0))
    return rows.select(
        *keep, "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("_base", F.transform("detections", lambda d: d["label"]))), ",").alias("labels"),
        F.greatest(best, F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("score"),
        "detections",
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("detections")


QUERIES = {"op9_licenses": op9_licenses}
ORACLES: dict[str, str] = {}
