"""Hand-written licence signatures, in order: priority | label | keyword | regex, over words in lower case with single spaces.

Priority 1: grant or condition texts; 2: machine-readable tags; 3: notices; 4: names with a version; 5: names; 6: addresses; 7: weak
or unversioned mentions. {L}: licence or license; {V}: an optional "version" or "v"; {U}: an optional "the"; {O}: or any later.
"""

RULES = r"""
1|mit|permission is hereby granted free|permission is hereby granted free of charge to any person obtaining a copy of this software
1|mit|without restriction including without|deal in the software without restriction including without limitation the rights to use copy
1|mit|substantial portions of the software|above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
1|mit-0|permission is hereby granted free|permission is hereby granted free of charge to any person obtaining a copy of this software(?: \S+){1,30} to permit persons to whom the software is furnished to do so the software is provided
1|x11|except as contained in this|except as contained in this notice the name(?: \S+){1,12} shall not be used in advertising
1|isc|permission to use copy modify|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
1|0bsd|permission to use copy modify|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
1|hpnd|permission to use copy modify|permission to use copy modify and distribute this software and its documentation for any purpose(?: \S+){0,6} without fee
1|ntp|permission to use copy modify|permission to use copy modify and distribute this software(?: \S+){0,12} suitability
1|bsd-2|redistribution and use in source|redistribution and use in source and binary forms with or without modification are permitted provided
1|bsd-2|redistributions of source code must|redistributions of source code must retain the above copyright notice
1|bsd-2|redistributions in binary form must|redistributions in binary form must reproduce the above copyright notice
1|bsd-3|endorse or promote products derived|neither the names? of(?: \S+){1,16} may be used to endorse or promote products derived
1|bsd-3|endorse or promote products derived|the names? of(?: \S+){1,16} may not be used to endorse or promote products derived
1|bsd-4|advertising materials mentioning features|all advertising materials mentioning features or use of this software must display
1|bsd-patent|patent license|redistribution and use in source(?: \S+){1,200} hereby grants to those receiving rights under this license a perpetual(?: \S+){1,16} patent license
1|zlib|without any express or implied|this software is provided as is without any express or implied warranty in no event will the authors be held liable
1|zlib|altered source versions|altered source versions must be plainly marked as such
1|zlib|must not be misrepresented|the origin of this software must not be misrepresented
1|libpng|png reference library|the png reference library is supplied as is
1|apache-2|you may not use this|licensed under the apache {L} version 2 0(?: the license)? you may not use this file except in compliance
1|apache-2|without warranties or conditions|unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions
1|apache-2|terms and conditions for use|terms and conditions for use reproduction and distribution 1 definitions
1|apache-1.1|software developed by the apache|this product includes software developed by the apache software foundation
1|gpl-1|either version 1|either version 1 (?:of the license )?or (?:at your option )?any later version
1|gpl-2|gnu general public|gnu general public {L}(?: \S+){0,12} either version 2 (?:of the license )?or (?:at your option )?any later version
1|gpl-3|gnu general public|gnu general public {L}(?: \S+){0,12} either version 3 (?:of the license )?or (?:at your option )?any later version
1|gpl-2|either version 2|free software(?: \S+){0,30} either version 2 of the license
1|gpl-3|either version 3|free software(?: \S+){0,30} either version 3 of the license
1|gpl-3|free copyleft license|the gnu general public {L} is a free copyleft {L} for software and other kinds of works
1|gpl-2|everyone is permitted to copy|gnu general public {L} version 2 june 1991(?: \S+){0,30} everyone is permitted to copy
1|lgpl-2.1|gnu lesser general|gnu lesser general public {L}(?: \S+){0,12} either version 2 1 of the license
1|lgpl-2|gnu library general|gnu library general public {L}(?: \S+){0,12} either version 2 of the license
1|lgpl-3|gnu lesser general|gnu lesser general public {L}(?: \S+){0,12} either version 3 of the license
1|agpl-3|gnu affero general|gnu affero general public {L}(?: \S+){0,12} either version 3 of the license
1|gpl|without even the implied warranty|without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
1|gpl|received a copy of|you should have received a copy of the gnu general public {L}
1|lgpl|received a copy of|you should have received a copy of the gnu (?:lesser|library) general public {L}
1|agpl|received a copy of|you should have received a copy of the gnu affero general public {L}
1|gpl-linking-exception|linking this library|linking this library statically or dynamically with other modules is making a combined work
1|gpl-classpath-exception|as a special exception|as a special exception(?: \S+){0,30} permission to link this library with independent modules
1|gcc-exception|gcc runtime library exception|gcc runtime library exception(?: version 3 1)?
1|mpl-2|subject to the terms of|this source code form is subject to the terms of the mozilla public {L} {V}2 0
1|mpl-1.1|mozilla public|the contents of this file are subject to the mozilla public {L} version 1 1
1|mpl-1|mozilla public|the contents of this file are subject to the mozilla public {L} version 1 0
1|npl-1.1|netscape public|the contents of this file are subject to the netscape public {L}
1|cddl-1|common development and distribution|the contents of this file are subject to the terms of the common development and distribution {L}
1|epl-1|eclipse public|accompanying materials(?: \S+){0,8} made available under the terms of the eclipse public {L} v1 0
1|epl-2|eclipse public|accompanying materials(?: \S+){0,8} made available under the terms of the eclipse public {L} (?:v )?2 0
1|cpl-1|common public license|accompanying materials(?: \S+){0,8} made available under the terms of the common public {L}
1|unlicense|released into the public domain|this is free and unencumbered software released into the public domain
1|unlicense|free to copy modify publish|anyone is free to copy modify publish use compile sell or distribute this software
1|cc0|waived all copyright|has waived all copyright and related or neighboring rights
1|cc0|to the extent possible under|to the extent possible under law(?: \S+){1,20} waived all copyright
1|wtfpl|what the fuck you want|you just do what the fuck you want to
1|wtfpl|what the fuck you want|do what the fuck you want to public {L}
1|boost|machine executable object code generated|machine executable object code generated by a source language processor
1|boost|permission is hereby granted free|permission is hereby granted free of charge to any person or organization obtaining a copy of the software
1|artistic-2|artistic license|everyone is permitted to copy and distribute verbatim copies of this {L} document(?: \S+){1,60} artistic {L}
1|artistic-1|standard version of this package|you may make and give away verbatim copies of the source form of the standard version of this package
1|postgresql|without a written agreement|without fee and without a written agreement is hereby granted
1|openssl|openssl toolkit|this product includes software developed by the openssl project for use in the openssl toolkit
1|ssleay|eric young|this product includes cryptographic software written by eric young
1|curl|any purpose with or without|permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided
1|ofl-1.1|sil open font|this font software is licensed under the sil open font {L}
1|ofl-1.1|reserved font name|with reserved font names?
1|php-3|this product includes php|this product includes php(?: software)? freely available from
1|python-2|python software foundation|this {L} agreement is between the python software foundation
1|ms-pl|this license governs use|this {L} governs use of the accompanying software(?: \S+){0,60} microsoft
1|bsl-1.1|make non production use|the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
1|sspl-1|the service source code|you must make the service source code available
1|elastic-2|hosted or managed service|you may not provide the software to third parties as a hosted or managed service
1|commons-clause|the grant of rights under|the grant of rights under the {L} will not include(?: \S+){0,20} the right to sell
1|beerware|buy me a beer|you can buy me a beer in return
1|jsonlicense|for good not evil|the software shall be used for good not evil
1|ncsa|university of illinois|deal with the software without restriction including(?: \S+){0,200} university of illinois
1|w3c|by obtaining using and or|by obtaining using and or copying this work you the licensee agree
1|cecill-2|cecill|this software is governed by the cecill {L}
1|eupl-1.2|eupl|licensed under the eupl {V}1 2
1|gfdl-1.3|gnu free documentation|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {L} version 1 3
1|gfdl-1.2|gnu free documentation|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {L} version 1 2
1|gfdl-1.1|gnu free documentation|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {L} version 1 1
1|proprietary|proprietary and confidential|(?:this \S+ is |unauthorized copying(?: \S+){0,12} )?(?:strictly prohibited )?proprietary and confidential
1|proprietary|unauthorized|unauthorized (?:copying|reproduction|use|distribution)(?: \S+){0,12} (?:strictly )?prohibited
1|proprietary|trade secrets of|contains trade secrets of
1|proprietary|no part of this|no part of this (?:publication|book|work|document|website) may be reproduced
1|proprietary|end user license agreement|(?:this )?end user {L} agreement (?:eula )?(?:is a legal agreement|between)
2|mit|spdx license identifier|spdx {L} identifier mit
2|apache-2|spdx license identifier|spdx {L} identifier apache 2 0
2|gpl-2|spdx license identifier|spdx {L} identifier gpl 2 0(?: only| or later)?
2|gpl-3|spdx license identifier|spdx {L} identifier gpl 3 0(?: only| or later)?
2|lgpl-2|spdx license identifier|spdx {L} identifier lgpl 2 0(?: only| or later)?
2|lgpl-2.1|spdx license identifier|spdx {L} identifier lgpl 2 1(?: only| or later)?
2|lgpl-3|spdx license identifier|spdx {L} identifier lgpl 3 0(?: only| or later)?
2|agpl-3|spdx license identifier|spdx {L} identifier agpl 3 0(?: only| or later)?
2|bsd-2|spdx license identifier|spdx {L} identifier bsd 2 clause
2|bsd-3|spdx license identifier|spdx {L} identifier bsd 3 clause
2|bsd-4|spdx license identifier|spdx {L} identifier bsd 4 clause
2|0bsd|spdx license identifier|spdx {L} identifier 0bsd
2|isc|spdx license identifier|spdx {L} identifier isc
2|mpl-1.1|spdx license identifier|spdx {L} identifier mpl 1 1
2|mpl-2|spdx license identifier|spdx {L} identifier mpl 2 0
2|epl-1|spdx license identifier|spdx {L} identifier epl 1 0
2|epl-2|spdx license identifier|spdx {L} identifier epl 2 0
2|cddl-1|spdx license identifier|spdx {L} identifier cddl 1 [01]
2|unlicense|spdx license identifier|spdx {L} identifier unlicense
2|cc0|spdx license identifier|spdx {L} identifier cc0 1 0
2|cc-by-nc-nd|spdx license identifier|spdx {L} identifier cc by nc nd [1-4] [05]
2|cc-by-nc-sa|spdx license identifier|spdx {L} identifier cc by nc sa [1-4] [05]
2|cc-by-nc|spdx license identifier|spdx {L} identifier cc by nc [1-4] [05]
2|cc-by-nd|spdx license identifier|spdx {L} identifier cc by nd [1-4] [05]
2|cc-by-sa|spdx license identifier|spdx {L} identifier cc by sa [1-4] [05]
2|cc-by|spdx license identifier|spdx {L} identifier cc by [1-4] [05]
2|zlib|spdx license identifier|spdx {L} identifier zlib
2|boost|spdx license identifier|spdx {L} identifier bsl 1 0
2|bsl-1.1|spdx license identifier|spdx {L} identifier busl 1 1
2|wtfpl|spdx license identifier|spdx {L} identifier wtfpl
2|artistic-2|spdx license identifier|spdx {L} identifier artistic 2 0
2|ofl-1.1|spdx license identifier|spdx {L} identifier ofl 1 1
2|postgresql|spdx license identifier|spdx {L} identifier postgresql
2|python-2|spdx license identifier|spdx {L} identifier (?:python|psf) 2 0
2|eupl-1.2|spdx license identifier|spdx {L} identifier eupl 1 2
2|upl-1|spdx license identifier|spdx {L} identifier upl 1 0
2|ncsa|spdx license identifier|spdx {L} identifier ncsa
2|mulan-2|spdx license identifier|spdx {L} identifier mulanpsl 2 0
2|blueoak-1|spdx license identifier|spdx {L} identifier blueoak 1 0 0
2|odbl-1|spdx license identifier|spdx {L} identifier odbl 1 0
3|mit|mit license|(?:licensed|released|distributed|available|published|provided) under {U}(?:terms of the )?mit {L}
3|apache-2|apache|(?:licensed|released|distributed|available|published|provided) under {U}(?:terms of the )?apache (?:{L} )?{V}2(?: 0)?(?: {L})?
3|gpl-2|gnu general public|(?:licensed|released|distributed|available|published|provided) under {U}(?:terms of the )?gnu general public {L} {V}2(?: 0)?
3|gpl-3|gnu general public|(?:licensed|released|distributed|available|published|provided) under {U}(?:terms of the )?gnu general public {L} {V}3(?: 0)?
3|lgpl-2.1|gnu lesser general|(?:licensed|released|distributed|available|published|provided) under {U}(?:terms of the )?gnu lesser general public {L} {V}2 1
3|lgpl-3|gnu lesser general|(?:licensed|released|distributed|available|published|provided) under {U}(?:terms of the )?gnu lesser general public {L} {V}3(?: 0)?
3|agpl-3|gnu affero general|(?:licensed|released|distributed|available|published|provided) under {U}(?:terms of the )?gnu affero general public {L} {V}3(?: 0)?
3|bsd-2|bsd|(?:licensed|released|distributed|available|published|provided) under {U}(?:terms of the )?(?:2 clause|simplified|freebsd) bsd {L}
3|bsd-3|bsd|(?:licensed|released|distributed|available|published|provided) under {U}(?:terms of the )?(?:3 clause|new|modified|revised) bsd {L}
3|bsd|bsd|(?:licensed|released|distributed|available|published|provided) under {U}(?:terms of the )?bsd {L}
3|mpl-2|mozilla public|(?:licensed|released|distributed|available|published|provided) under {U}(?:terms of the )?mozilla public {L} {V}2(?: 0)?
3|isc|isc license|(?:licensed|released|distributed|available|published|provided) under {U}(?:terms of the )?isc {L}
3|unlicense|unlicense|(?:licensed|released|distributed|available|published|provided) under {U}unlicense
3|cc0|cc0|(?:licensed|released|distributed|available|published|dedicated) (?:under|to) {U}(?:creative commons )?cc0(?: 1 0)?
3|cc-by-nc-nd|cc by nc nd|(?:licensed|released|distributed|available|published|shared) under {U}(?:creative commons )?cc by nc nd(?: [1-4] [05])?
3|cc-by-nc-sa|cc by nc sa|(?:licensed|released|distributed|available|published|shared) under {U}(?:creative commons )?cc by nc sa(?: [1-4] [05])?
3|cc-by-nc|cc by nc|(?:licensed|released|distributed|available|published|shared) under {U}(?:creative commons )?cc by nc(?: [1-4] [05])?
3|cc-by-nd|cc by nd|(?:licensed|released|distributed|available|published|shared) under {U}(?:creative commons )?cc by nd(?: [1-4] [05])?
3|cc-by-sa|cc by sa|(?:licensed|released|distributed|available|published|shared) under {U}(?:creative commons )?cc by sa(?: [1-4] [05])?
3|cc-by|cc by|(?:licensed|released|distributed|available|published|shared) under {U}(?:creative commons )?cc by(?: [1-4] [05])?
3|public-domain|public domain|(?:this work|this software|this document|it) (?:is|has been) (?:placed |released |dedicated )?(?:in|into|to) the public domain
3|public-domain|public domain|(?:placed|released|dedicated) (?:in|into|to) the public domain
3|public-domain|public domain mark|public domain mark(?: 1 0)?
3|public-domain|united states government|(?:is a )?work of the united states government(?: \S+){0,20} not subject to copyright
3|all-rights-reserved|all rights reserved|(?:copyright (?:\S+ ){0,8})?all rights reserved
3|all-rights-reserved|tous droits|tous droits réservés
3|all-rights-reserved|rechte vorbehalten|alle rechte vorbehalten
3|all-rights-reserved|derechos reservados|todos los derechos reservados
3|all-rights-reserved|diritti riservati|tutti i diritti riservati
3|all-rights-reserved|direitos reservados|todos os direitos reservados
3|all-rights-reserved|rechten voorbehouden|alle rechten voorbehouden
3|proprietary|may not be copied|may not be copied (?:or|reproduced|distributed)(?: \S+){0,10} without (?:the )?(?:prior )?(?:express )?(?:written )?permission
3|proprietary|prior written|without (?:the )?(?:express )?prior written (?:permission|consent)
3|no-derivatives|no derivative|no derivative works? (?:are |is )?(?:allowed|permitted)
3|noncommercial|non commercial|for (?:personal and )?non commercial use only
3|noncommercial|noncommercial|for (?:personal and )?noncommercial use only
3|noncommercial|commercial use is|commercial use is (?:not permitted|prohibited|forbidden|not allowed)
3|noncommercial|purposes only|for (?:academic|research|educational) purposes only
3|dual-license|dual licensed|dual licensed under
4|gpl-1|general public license|(?:gnu )?general public {L} {V}1(?: 0)?{O}
4|gpl-2|general public license|(?:gnu )?general public {L} {V}2(?: 0)?{O}
4|gpl-3|general public license|(?:gnu )?general public {L} {V}3(?: 0)?{O}
4|gpl-2|gpl|(?:gnu )?gpl ?{V}2(?: 0)?(?: only{O}|{O})
4|gpl-3|gpl|(?:gnu )?gpl ?{V}3(?: 0)?(?: only{O}|{O})
4|gpl-2|gplv2|gplv2(?: 0)?{O}
4|gpl-3|gplv3|gplv3(?: 0)?{O}
4|lgpl-2|library general public|(?:gnu )?library general public {L}(?: {V}2(?: 0)?)?{O}
4|lgpl-2.1|lesser general public|(?:gnu )?lesser general public {L} {V}2 1{O}
4|lgpl-3|lesser general public|(?:gnu )?lesser general public {L} {V}3(?: 0)?{O}
4|lgpl-2.1|lgpl|(?:gnu )?lgpl ?{V}2 1{O}
4|lgpl-3|lgpl|(?:gnu )?lgpl ?{V}3(?: 0)?{O}
4|lgpl-2.1|lgplv2|lgplv2 1{O}
4|lgpl-3|lgplv3|lgplv3(?: 0)?{O}
4|agpl-3|affero general public|(?:gnu )?affero general public {L} {V}3(?: 0)?{O}
4|agpl-3|agpl|(?:gnu )?agpl ?{V}3(?: 0)?{O}
4|agpl-3|agplv3|agplv3(?: 0)?{O}
4|apache-2|apache|apache (?:software )?(?:{L} )?{V}2(?: 0)?(?: {L})?
4|apache-1.1|apache|apache (?:software )?{L} {V}1 1
4|apache-1|apache|apache (?:software )?{L} {V}1 0
4|apache-2|asl|asl 2 0
4|mpl-1.1|mozilla public license|mozilla public {L} {V}1 1
4|mpl-1|mozilla public license|mozilla public {L} {V}1 0
4|mpl-2|mozilla public license|mozilla public {L} {V}2(?: 0)?
4|mpl-2|mpl|mpl 2 0
4|epl-1|eclipse public license|eclipse public {L} (?:{V}|v)1(?: 0)?
4|epl-2|eclipse public license|eclipse public {L} (?:{V}|v)2(?: 0)?
4|edl-1|eclipse distribution license|eclipse distribution {L} (?:{V}|v)1 0
4|cddl-1|common development and distribution|common development and distribution {L}(?: cddl)?(?: {V}1 [01])?
4|cpl-1|common public license|common public {L}(?: {V}1 0)?
4|osl-3|open software license|open software {L} {V}3 0
4|afl-3|academic free license|academic free {L} {V}3 0
4|afl-2.1|academic free license|academic free {L} {V}2 1
4|eupl-1.2|european union public|european union public licen[cs]e(?: {V}1 2)?
4|eupl-1.1|european union public|european union public licen[cs]e {V}1 1
4|artistic-2|artistic license|artistic {L} {V}2 0
4|artistic-1|artistic license|artistic {L} {V}1 0
4|bsl-1.1|business source license|business source {L}(?: {V}1 1)?
4|sspl-1|server side public license|server side public {L}(?: {V}1)?
4|elastic-2|elastic license|elastic {L} {V}2 0
4|boost|boost software license|boost software {L}(?: {V}1 0)?
4|ofl-1.1|open font license|(?:sil )?open font {L}(?: {V}1 1)?
4|gfdl-1.3|free documentation license|(?:gnu )?free documentation {L} {V}1 3{O}
4|gfdl-1.2|free documentation license|(?:gnu )?free documentation {L} {V}1 2{O}
4|odbl-1|open database license|open (?:data commons open )?database {L}(?: odbl)?(?: {V}1 0)?
4|odc-by-1|open data commons attribution|open data commons attribution {L}(?: {V}1 0)?
4|pddl-1|public domain dedication|(?:open data commons )?public domain dedication and {L}
4|cdla-permissive-2|community data license|community data {L} agreement permissive(?: {V}2 0)?
4|cdla-sharing-1|community data license|community data {L} agreement sharing(?: {V}1 0)?
4|ms-pl|microsoft public license|microsoft public {L}(?: ms pl)?
4|ms-rl|microsoft reciprocal license|microsoft reciprocal {L}(?: ms rl)?
4|upl-1|universal permissive license|universal permissive {L}(?: {V}1 0)?
4|zpl-2.1|zope public license|zope public {L}(?: zpl)?(?: {V}2 1)?
4|php-3|php license|php {L} {V}3(?: 0[01]?)?
4|python-2|python software foundation license|python software foundation {L}(?: {V}2)?
4|cecill-2.1|cecill|cecill(?: free software)? {L}(?: agreement)?(?: {V}2 1)?
4|openrail-m|openrail m|(?:creativeml |bigscience )?(?:big ?code )?openrail m(?: {L})?
4|openrail|responsible ai license|responsible ai {L}s?
4|llama-community|community license agreement|llama [234](?: \d)? community {L} agreement
4|mulan-2|mulan permissive software|mulan permissive software {L} (?:{V}|v)2
4|ogl-3|open government licence|open government {L} (?:{V}|v)3(?: 0)?
4|ogl-2|open government licence|open government {L} (?:{V}|v)2(?: 0)?
4|cern-ohl-2|cern open hardware|cern open hardware licen[cs]e {V}2
4|cc-by-nc-nd|noncommercial no|(?:creative commons )?attribution noncommercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported)?
4|cc-by-nc-nd|non commercial no|(?:creative commons )?attribution non commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported)?
4|cc-by-nc-sa|noncommercial share|(?:creative commons )?attribution noncommercial share ?alike(?: [1-4] [05])?(?: international| unported)?
4|cc-by-nc-sa|non commercial share|(?:creative commons )?attribution non commercial share ?alike(?: [1-4] [05])?(?: international| unported)?
4|cc-by-nc|attribution noncommercial|(?:creative commons )?attribution noncommercial(?: [1-4] [05])?(?: international| unported)?
4|cc-by-nc|attribution non commercial|(?:creative commons )?attribution non commercial(?: [1-4] [05])?(?: international| unported)?
4|cc-by-nd|attribution no|creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported)?
4|cc-by-sa|attribution share|(?:creative commons )?attribution share ?alike(?: [1-4] [05])?(?: international| unported)?
4|cc-by|creative commons attribution|creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: {L})?
4|cc0|creative commons zero|creative commons zero(?: v?1 0)?(?: universal)?
4|cc0|cc0|cc0(?: 1 0)?(?: universal)?
4|cc-by-nc-nd|cc by nc nd|cc by nc nd(?: [1-4] [05])?
4|cc-by-nc-sa|cc by nc sa|cc by nc sa(?: [1-4] [05])?
4|cc-by-nc|cc by nc|cc by nc(?: [1-4] [05])?
4|cc-by-nd|cc by nd|cc by nd [1-4] [05]
4|cc-by-sa|cc by sa|cc by sa(?: [1-4] [05])?
4|cc-by|cc by|cc by [1-4] [05]
5|mit|mit license|(?:under )?{U}mit {L}
5|mit|expat license|expat {L}
5|x11|x11 license|x11 {L}
5|isc|isc license|{U}isc {L}
5|bsd-2|2 clause bsd|2 clause bsd(?: {L})?
5|bsd-2|bsd 2 clause|bsd 2 clause(?: {L})?
5|bsd-2|simplified bsd|simplified bsd {L}
5|bsd-3|3 clause bsd|3 clause bsd(?: {L})?
5|bsd-3|bsd 3 clause|bsd 3 clause(?: {L})?
5|bsd-3|new bsd|new bsd {L}
5|bsd-4|4 clause bsd|4 clause bsd(?: {L})?
5|0bsd|zero clause bsd|zero clause bsd(?: {L})?
5|zlib|zlib|zlib(?: libpng)? {L}
5|openssl|openssl license|openssl {L}
5|postgresql|postgresql license|postgresql {L}
5|unlicense|the unlicense|the unlicense
5|beerware|beerware|beerware(?: {L})?
5|wtfpl|wtfpl|wtfpl(?: v?2)?
5|ruby|ruby license|ruby {L}
5|ncsa|ncsa|(?:university of illinois )?ncsa open source {L}
5|vim|vim license|vim {L}
5|tcl|tcl|tcl(?: tk)? {L}
5|jsonlicense|json license|json {L}
5|w3c|w3c software|w3c software (?:notice and )?{L}
5|unicode|unicode license|unicode {L}(?: v3| agreement)?
5|polyform-nc|polyform noncommercial|polyform noncommercial {L}(?: 1 0 0)?
5|commons-clause|commons clause|commons clause(?: {L} condition)?
5|blueoak-1|blue oak model|blue oak model {L}(?: 1 0 0)?
6|gpl|gnu org licenses|gnu org licenses gpl(?: \d \d)?(?: html| txt)?
6|lgpl|gnu org licenses|gnu org licenses lgpl(?: \d \d)?(?: html| txt)?
6|agpl|gnu org licenses|gnu org licenses agpl(?: \d \d)?(?: html| txt)?
6|gfdl|gnu org licenses|gnu org licenses fdl(?: \d \d)?(?: html| txt)?
6|apache-2|apache org licenses|apache org licenses {L} 2 0(?: html| txt)?
6|mit|opensource org licenses|opensource org licenses mit(?: {L} php)?
6|bsd-3|opensource org licenses|opensource org licenses bsd 3 clause
6|bsd-2|opensource org licenses|opensource org licenses bsd 2 clause
6|mpl-2|mozilla org|mozilla org (?:en us )?mpl 2 0
6|cc0|creativecommons org publicdomain|creativecommons org publicdomain zero 1 0
6|public-domain|creativecommons org publicdomain|creativecommons org publicdomain mark 1 0
6|cc-by-nc-nd|creativecommons org licenses|creativecommons org licenses by nc nd [1-4] [05]
6|cc-by-nc-sa|creativecommons org licenses|creativecommons org licenses by nc sa [1-4] [05]
6|cc-by-nc|creativecommons org licenses|creativecommons org licenses by nc [1-4] [05]
6|cc-by-nd|creativecommons org licenses|creativecommons org licenses by nd [1-4] [05]
6|cc-by-sa|creativecommons org licenses|creativecommons org licenses by sa [1-4] [05]
6|cc-by|creativecommons org licenses|creativecommons org licenses by [1-4] [05]
6|unlicense|unlicense org|unlicense org
6|wtfpl|wtfpl net|wtfpl net
6|boost|boost org license|boost org {L} 1 0 txt
6|epl-2|eclipse org legal|eclipse org legal epl (?:2 0|v20)(?: html)?
6|epl-1|eclipse org legal|eclipse org legal epl (?:1 0|v10)(?: html)?
6|ofl-1.1|scripts sil org|scripts sil org ofl
7|gpl|general public license|(?:gnu )?general public {L}
7|lgpl|lesser general public|(?:gnu )?lesser general public {L}
7|agpl|affero general public|(?:gnu )?affero general public {L}
7|gfdl|free documentation license|gnu free documentation {L}
7|mpl|mozilla public license|mozilla public {L}
7|epl|eclipse public license|eclipse public {L}
7|artistic|artistic license|{U}artistic {L}
7|bsd|bsd license|{U}(?:original )?bsd {L}
7|bsd|bsd style|bsd style {L}
7|mit|mit style|mit style {L}
7|apache|apache license|{U}apache {L}
7|creative-commons|creative commons license|creative commons {L}s?
7|see-license|see license|see {L} (?:file|txt|md)(?: for (?:details|license information))?
7|see-license|license file|(?:found|included|listed) in the {L} file
""".strip()

ABBREVIATIONS = {"{L}": "licen[cs]e", "{V}": "(?:version |v ?)?", "{U}": "(?:the )?", "{O}": "(?: (?:only|or (?:at your option )?(?:any )?later(?: version)?))?"}
#: How sure a detection of each priority is.
CONFIDENCE = {1: 0.99, 2: 0.98, 3: 0.95, 4: 0.9, 5: 0.8, 6: 0.85, 7: 0.5}


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, regex), abbreviations written out."""
    out = []
    for line in RULES.split("\n"):
        priority, label, keyword, regex = line.split("|", 3)
        for short, long in ABBREVIATIONS.items():
            regex = regex.replace(short, long)
        out.append((int(priority), label, keyword, regex))
    return out
