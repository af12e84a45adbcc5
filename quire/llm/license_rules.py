"""Hand-written licence signatures over normalised text: lower-case words joined by single blanks.

``FAMILIES`` are names of licences: (words, rules), a rule is (label, regex).  A match may begin with words that
grant the licence, or with an SPDX tag.  ``TEXTS`` are phrases of licence texts and notices: (word, label, regex).
Regexes match whole words.  Whatever a rule can match holds one of its words, so a text without any of them is
left out by looking at its words alone (a tag may stand for the name, so every family has the word spdx too).

Priorities: 4 tags, 3 grants and phrases, 2 names with a version, 1 bare names.  Of equal detections the
earlier rule counts.
"""

V = r"(?:version |v ?)?"

FAMILIES = [
    (("gpl", "general", "gplv2", "gplv3"), [
        ("gpl-1.0", rf"(?:gnu )?(?:general public licen[cs]e|gpl) {V}1(?: 0)?"),
        ("gpl-2.0", rf"(?:gnu )?(?:general public licen[cs]e|gpl) {V}2(?: 0)?"),
        ("gpl-2.0", r"(?:gnu )?gplv2"),
        ("gpl-3.0", rf"(?:gnu )?(?:general public licen[cs]e|gpl) {V}3(?: 0)?"),
        ("gpl-3.0", r"(?:gnu )?gplv3"),
        ("gpl", r"(?:gnu )?(?:general public licen[cs]e|gpl)"),
    ]),
    (("lgpl", "library", "lesser", "lgplv2", "lgplv3"), [
        ("lgpl-2.0", rf"(?:gnu )?(?:(?:library|lesser) general public licen[cs]e|lgpl) {V}2(?: 0)?"),
        ("lgpl-2.1", rf"(?:gnu )?(?:lesser general public licen[cs]e|lgpl) {V}2 1"),
        ("lgpl-2.1", r"(?:gnu )?lgplv2 1"),
        ("lgpl-3.0", rf"(?:gnu )?(?:lesser general public licen[cs]e|lgpl) {V}3(?: 0)?"),
        ("lgpl-3.0", r"(?:gnu )?lgplv3"),
        ("lgpl", r"(?:gnu )?(?:(?:library|lesser) general public licen[cs]e|lgpl)"),
    ]),
    (("agpl", "affero", "agplv3"), [
        ("agpl-1.0", rf"(?:affero general public licen[cs]e|agpl) {V}1(?: 0)?"),
        ("agpl-3.0", rf"(?:gnu )?(?:affero general public licen[cs]e|agpl) {V}3(?: 0)?"),
        ("agpl-3.0", r"(?:gnu )?agplv3"),
        ("agpl", r"(?:gnu )?(?:affero general public licen[cs]e|agpl)"),
    ]),
    (("documentation", "gfdl", "fdl"), [
        ("fdl-1.1", rf"(?:gnu )?(?:free documentation license|gfdl|fdl) {V}1 1"),
        ("fdl-1.2", rf"(?:gnu )?(?:free documentation license|gfdl|fdl) {V}1 2"),
        ("fdl-1.3", rf"(?:gnu )?(?:free documentation license|gfdl|fdl) {V}1 3"),
        ("fdl", r"(?:gnu )?free documentation license"),
        ("freebsd-doc", r"freebsd documentation license"),
    ]),
    (("apache",), [
        ("apache-1.0", rf"apache (?:software )?license {V}1(?: 0)?"),
        ("apache-1.1", rf"apache (?:software )?license {V}1 1"),
        ("apache-2.0", rf"apache (?:software )?(?:license )?{V}2(?: 0)?(?: license)?"),
        ("apache", r"apache (?:software |public )?licen[cs]e"),
    ]),
    (("license", "licence", "mit"), [
        ("mit", r"(?:mit|expat|x11) (?:style )?licen[cs]e"),
        ("mit-0", r"mit (?:no attribution|0)(?: license)?"),
        ("mit-cmu", r"cmu license"),
        ("ntp", r"ntp license"),
        ("curl", r"curl license"),
    ]),
    (("bsd", "freebsd", "0bsd"), [
        ("bsd-1-clause", r"bsd (?:1|one) clause(?: license)?"),
        ("bsd-2-clause-patent", r"bsd (?:2|two) clause plus patent(?: license)?"),
        ("bsd-2-clause", r"(?:bsd (?:2|two) clause|simplified bsd|freebsd)(?: license)?"),
        ("bsd-2-clause", r"(?:2|two) clause bsd(?: license)?"),
        ("bsd-3-clause-clear", r"bsd (?:3|three) clause clear(?: license)?"),
        ("bsd-3-clause", r"(?:bsd (?:3|three) clause|(?:new|revised|modified) bsd)(?: license)?"),
        ("bsd-3-clause", r"(?:3|three) clause bsd(?: license)?"),
        ("bsd-4-clause", r"(?:bsd (?:4|four) clause|original bsd)(?: license)?"),
        ("0bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)(?: license)?"),
        ("bsd", r"bsd(?: style)? licen[cs]e"),
    ]),
    (("isc",), [("isc", r"isc licen[cs]e")]),
    (("zlib", "libpng"), [
        ("zlib", r"zlib(?: libpng)? licen[cs]e"),
        ("libpng", r"libpng license"),
    ]),
    (("mozilla", "mpl"), [
        ("mpl-1.0", rf"(?:mozilla public license|mpl) {V}1(?: 0)?"),
        ("mpl-1.1", rf"(?:mozilla public license|mpl) {V}1 1"),
        ("mpl-2.0", rf"(?:mozilla public license|mpl) {V}2(?: 0)?"),
        ("mpl", r"mozilla public licen[cs]e"),
    ]),
    (("eclipse", "epl"), [
        ("epl-1.0", rf"(?:eclipse public license|epl) {V}1(?: 0)?"),
        ("epl-2.0", rf"(?:eclipse public license|epl) {V}2(?: 0)?"),
        ("epl", r"eclipse public licen[cs]e"),
        ("edl-1.0", rf"eclipse distribution license(?: {V}1(?: 0)?)?"),
    ]),
    (("cddl", "distribution"), [
        ("cddl-1.0", rf"(?:common development and distribution license|cddl) {V}1(?: 0)?"),
        ("cddl-1.1", rf"(?:common development and distribution license|cddl) {V}1 1"),
        ("cddl", r"common development and distribution license"),
    ]),
    (("common",), [
        ("cpl-1.0", rf"common public license(?: {V}1(?: 0)?)?"),
        ("cpal-1.0", rf"common public attribution license(?: {V}1(?: 0)?)?"),
    ]),
    (("public",), [
        ("ipl-1.0", rf"ibm public license(?: {V}1(?: 0)?)?"),
        ("lpl-1.02", rf"lucent public license(?: {V}1 02)?"),
        ("spl-1.0", rf"sun public license(?: {V}1(?: 0)?)?"),
        ("apsl-2.0", rf"apple public source license(?: {V}2(?: 0)?)?"),
        ("rpsl-1.0", rf"realnetworks public source license(?: {V}1(?: 0)?)?"),
        ("watcom-1.0", rf"sybase open watcom public license(?: {V}1(?: 0)?)?"),
        ("npl-1.1", rf"netscape public license(?: {V}1 1)?"),
        ("ypl-1.1", rf"yahoo public license(?: {V}1 1)?"),
        ("zpl-2.1", rf"zope public license(?: {V}2 1)?"),
        ("qpl-1.0", rf"(?:q|qt) public license(?: {V}1(?: 0)?)?"),
        ("oldap-2.8", rf"openldap public license(?: {V}2 8)?"),
        ("erlpl-1.1", rf"erlang public license(?: {V}1 1)?"),
        ("rpl-1.5", rf"reciprocal public license(?: {V}1 5)?"),
        ("sspl-1.0", rf"server side public license(?: {V}1(?: 0)?)?"),
        ("wtfpl", r"do what the fuck you want to public license"),
        ("lppl-1.3c", rf"latex project public license(?: {V}1 3c?)?"),
        ("ms-pl", r"microsoft public license"),
        ("pddl-1.0", r"public domain dedication and licen[cs]e"),
        ("mulan", r"mulan public license"),
        ("ngpl", r"nethack general public license"),
    ]),
    (("software",), [
        ("nokia", r"nokia software license"),
        ("sgi-b-2.0", rf"sgi free software license b(?: {V}2(?: 0)?)?"),
        ("bsl-1.0", rf"boost software license(?: {V}1(?: 0)?)?"),
        ("psf-2.0", rf"python software foundation license(?: {V}2(?: 0)?)?"),
        ("w3c", r"w3c software(?: and document)?(?: notice and)? license"),
        ("osl-3.0", rf"open software license {V}3(?: 0)?"),
        ("osl", r"open software license"),
        ("naumen", r"naumen software license"),
        ("entessa", r"entessa software license"),
    ]),
    (("source",), [
        ("busl-1.1", rf"business source license(?: {V}1 1)?"),
        ("sissl", r"sun industry standards source license"),
        ("intel", r"intel open source license"),
        ("ncsa", r"university of illinois ncsa open source license"),
        ("nasa-1.3", rf"nasa open source agreement(?: {V}1 3)?"),
        ("motosoto", r"motosoto open source license"),
    ]),
    (("european", "eupl"), [
        ("eupl-1.1", rf"(?:european union public licen[cs]e|eupl) {V}1 1"),
        ("eupl-1.2", rf"(?:european union public licen[cs]e|eupl) {V}1 2"),
        ("eupl", r"european union public licen[cs]e"),
    ]),
    (("cecill",), [
        ("cecill-2.1", rf"cecill (?:license )?{V}2 1"),
        ("cecill-b", r"cecill b(?: license)?"),
        ("cecill-c", r"cecill c(?: license)?"),
        ("cecill", r"cecill(?: free software)? license"),
    ]),
    (("academic",), [("afl-3.0", rf"academic free license(?: {V}3(?: 0)?)?")]),
    (("artistic",), [
        ("artistic-1.0", rf"artistic license {V}1(?: 0)?"),
        ("artistic-2.0", rf"artistic license {V}2(?: 0)?"),
        ("clartistic", r"clarified artistic license"),
        ("artistic", r"artistic license"),
    ]),
    (("elastic",), [("elastic-2.0", rf"elastic license(?: {V}2(?: 0)?)?")]),
    (("unlicense",), [("unlicense", r"(?:the )?unlicense")]),
    (("postgresql",), [("postgresql", r"postgresql licen[cs]e")]),
    (("psf", "python"), [("python-2.0", rf"(?:psf|python) license(?: {V}2(?: 0)?)?")]),
    (("ruby",), [("ruby", r"ruby license")]),
    (("php",), [("php-3.01", rf"php license(?: {V}3 0?1)?")]),
    (("openssl",), [("openssl", r"openssl license")]),
    (("vim",), [("vim", r"vim license")]),
    (("tcl",), [("tcl", r"tcl(?: tk)? license")]),
    (("icu", "unicode"), [
        ("icu", r"icu license"),
        ("unicode", r"unicode(?: data files and software)? license"),
    ]),
    (("imagemagick",), [("imagemagick", r"imagemagick license")]),
    (("sleepycat",), [("sleepycat", r"sleepycat license")]),
    (("zend",), [("zend-2.0", rf"zend license(?: {V}2(?: 0)?)?")]),
    (("beerware",), [("beerware", r"beerware(?: license)?")]),
    (("json",), [("json", r"json license")]),
    (("commons", "clause"), [("commons-clause", r"commons clause(?: license)?(?: condition)?")]),
    (("polyform",), [
        ("polyform-noncommercial-1.0.0", r"polyform noncommercial license(?: 1 0 0)?"),
        ("polyform-small-business-1.0.0", r"polyform small business license(?: 1 0 0)?"),
    ]),
    (("rail", "openrail", "bigscience", "llama"), [
        ("bigscience-rail", r"bigscience (?:bloom )?rail(?: license)?"),
        ("openrail", r"(?:creativeml )?openrail(?: m)?(?: license)?"),
        ("llama", r"llama (?:[234] )?community license(?: agreement)?"),
    ]),
    (("font",), [("ofl-1.1", rf"(?:sil )?open font license(?: {V}1 1)?")]),
    (("microsoft",), [("ms-rl", r"microsoft reciprocal license")]),
    (("permissive",), [("upl-1.0", rf"universal permissive license(?: {V}1(?: 0)?)?")]),
    (("oak",), [("blueoak-1.0.0", r"blue oak model license(?: 1 0 0)?")]),
    (("database", "data", "odbl", "cdla"), [
        ("odbl-1.0", rf"(?:open (?:database|data commons open database) license|odbl)(?: {V}1(?: 0)?)?"),
        ("odc-by-1.0", r"open data commons attribution license"),
        ("cdla-permissive-2.0", rf"(?:community data license agreement|cdla) permissive(?: {V}2(?: 0)?)?"),
        ("cdla-sharing-1.0", rf"(?:community data license agreement|cdla) sharing(?: {V}1(?: 0)?)?"),
        ("dl-de-by-2.0", rf"data licence germany attribution(?: {V}2(?: 0)?)?"),
    ]),
    (("government",), [
        ("ogl-uk-3.0", rf"open government licen[cs]e {V}3(?: 0)?"),
        ("ogl-uk", r"open government licen[cs]e"),
    ]),
    (("publication", "game", "content"), [
        ("opl-1.0", rf"open publication license(?: {V}1(?: 0)?)?"),
        ("ogl-1.0a", rf"open game license(?: {V}1 0a)?"),
        ("opencontent", r"open content license"),
    ]),
    (("art",), [("lal-1.3", rf"(?:free art license|licence art libre)(?: {V}1 3)?")]),
    (("cc", "cc0", "creative"), [
        ("cc0-1.0", rf"(?:cc0|cc zero|creative commons zero)(?: {V}1 0)?(?: universal)?"),
        ("cc-by-1.0", rf"(?:cc by|creative commons attribution) {V}1 0"),
        ("cc-by-2.0", rf"(?:cc by|creative commons attribution) {V}2 0"),
        ("cc-by-2.5", rf"(?:cc by|creative commons attribution) {V}2 5"),
        ("cc-by-3.0", rf"(?:cc by|creative commons attribution) {V}3 0"),
        ("cc-by-4.0", rf"(?:cc by|creative commons attribution) {V}4 0"),
        ("cc-by-sa-2.0", rf"(?:cc by sa|creative commons attribution share ?alike) {V}2 0"),
        ("cc-by-sa-2.5", rf"(?:cc by sa|creative commons attribution share ?alike) {V}2 5"),
        ("cc-by-sa-3.0", rf"(?:cc by sa|creative commons attribution share ?alike) {V}3 0"),
        ("cc-by-sa-4.0", rf"(?:cc by sa|creative commons attribution share ?alike) {V}4 0"),
        ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)"),
        ("cc-by-nd-3.0", rf"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s) {V}3 0"),
        ("cc-by-nd-4.0", rf"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s) {V}4 0"),
        ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)"),
        ("cc-by-nc-2.0", rf"(?:cc by nc|creative commons attribution non ?commercial) {V}2 0"),
        ("cc-by-nc-3.0", rf"(?:cc by nc|creative commons attribution non ?commercial) {V}3 0"),
        ("cc-by-nc-4.0", rf"(?:cc by nc|creative commons attribution non ?commercial) {V}4 0"),
        ("cc-by-nc-sa-3.0", rf"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) {V}3 0"),
        ("cc-by-nc-sa-4.0", rf"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) {V}4 0"),
        ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)"),
        ("cc-by-nc-nd-3.0", rf"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s) {V}3 0"),
        ("cc-by-nc-nd-4.0", rf"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s) {V}4 0"),
        ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)"),
        ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)"),
        ("cc-by", r"(?:cc by|creative commons attribution)(?: license)?"),
        ("creative-commons", r"creative commons(?: public)? licen[cs]e"),
    ]),
]

TEXTS = [
    # permissive grants
    ("permission", "mit", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("substantial", "mit", r"shall be included in all copies or substantial portions of the software"),
    ("sublicense", "mit", r"use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("permission", "isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("permission", "hpnd", r"permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose (?:is hereby granted )?without fee"),
    ("advertising", "hpnd", r"not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission"),
    ("redistributions", "bsd", r"redistributions of source code must retain the above copyright notice"),
    ("redistributions", "bsd", r"redistributions in binary form must reproduce the above copyright notice"),
    ("redistribution", "bsd", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("endorse", "bsd-3-clause", r"neither the name of (?:\S+ ){1,12}may be used to endorse or promote products"),
    ("endorse", "bsd-3-clause", r"the names? of (?:\S+ ){1,8}may not be used to endorse or promote products"),
    ("advertising", "bsd-4-clause", r"all advertising materials mentioning features or use of this software must display"),
    ("altered", "zlib", r"altered source versions must be plainly marked as such"),
    ("authors", "zlib", r"in no event will the authors be held liable for any damages"),
    ("misrepresented", "zlib", r"the origin of this software must not be misrepresented"),
    ("acknowledgment", "openssl", r"this product includes software developed by the openssl project (?:\S+ ){0,9}acknowledgment|acknowledgment this product includes software developed by the openssl project"),
    ("cryptographic", "ssleay", r"this product includes cryptographic software written by eric young"),
    ("boost", "bsl-1.0", r"distributed under the boost software license"),
    ("obtaining", "bsl-1.0", r"any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("postgresql", "postgresql", r"the postgresql global development group (?:\S+ ){0,6}permission to use copy modify and distribute|portions copyright (?:\S+ ){0,6}the postgresql global development group"),
    ("regents", "bsd", r"the regents of the university of california all rights reserved"),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("beer", "beerware", r"you can buy me a beer in return"),
    ("good", "json", r"the software shall be used for good not evil"),
    ("python", "python-2.0", r"this license agreement is between the python software foundation"),
    ("font", "ofl-1.1", r"this font software is licensed under"),
    ("reserved", "ofl-1.1", r"reserved font names?"),
    ("fuck", "wtfpl", r"you just do what the fuck you want to"),
    # the gnu family
    ("redistribute", "gpl", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("received", "gpl", r"you should have received a copy of the gnu general public license"),
    ("redistribute", "lgpl", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("received", "lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("redistribute", "agpl", r"you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("received", "agpl", r"you should have received a copy of the gnu affero general public license"),
    ("published", "gpl", r"as published by the free software foundation"),
    ("later", "gpl-2.0+", r"either version 2 of the license or at your option any later version"),
    ("later", "gpl-3.0+", r"either version 3 of the license or at your option any later version"),
    ("verbatim", "gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("copyleft", "gpl", r"the gnu general public license is a free copyleft license"),
    ("freedom", "gpl", r"guarantee your freedom to share and change free software"),
    ("exception", "gpl-linking-exception", r"as a special exception (?:\S+ ){0,12}link(?:ing)? this"),
    ("classpath", "gpl-classpath-exception", r"classpath exception"),
    ("runtime", "gcc-runtime-exception", r"gcc runtime library exception"),
    ("invariant", "fdl", r"with no invariant sections no front cover texts and no back cover texts"),
    ("network", "agpl", r"interacting with it remotely through a computer network"),
    # apache and the other large families
    ("licenses", "apache-2.0", r"www apache org licenses license 2 0"),
    ("applicable", "apache-2.0", r"unless required by applicable law or agreed to in writing software distributed under the license"),
    ("compliance", "apache-2.0", r"you may not use this file except in compliance with the license"),
    ("contributor", "apache-2.0", r"contributor license agreements see the notice file distributed with this work"),
    ("apache", "apache-1.1", r"this product includes software developed by the apache software foundation"),
    ("mozilla", "mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mozilla", "mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("incompatible", "mpl-2.0", r"this source code form is incompatible with secondary licenses"),
    ("eclipse", "epl", r"made available under the terms of the eclipse public license"),
    ("recipient", "epl", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cddl", "cddl-1.0", r"the contents of this file are subject to the terms of the common development and distribution license(?: the license)? cddl|cddl header start"),
    ("artistic", "artistic", r"under the terms of the artistic license|the intent of this document is to state the conditions under which a package may be copied (?:\S+ ){0,20}artistic"),
    ("perl", "artistic-or-gpl", r"under the same terms as perl itself"),
    ("latex", "lppl-1.3c", r"this work may be distributed and or modified under the conditions of the latex project public license"),
    ("elastic", "elastic-2.0", r"licensed under the elastic license"),
    ("managed", "elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service"),
    ("licensor", "busl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    # public domain
    ("unencumbered", "unlicense", r"this is free and unencumbered software released into the public domain"),
    ("neighboring", "cc0-1.0", r"has waived all copyright and related or neighboring rights"),
    ("domain", "public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("domain", "public-domain", r"(?:is|are) in the public domain"),
    ("domain", "public-domain", r"public domain mark"),
    ("copyright", "public-domain", r"no known copyright restrictions"),
    ("copyright", "public-domain", r"the author disclaims copyright to this source code"),
    ("gutenberg", "gutenberg", r"project gutenberg(?: tm)? license"),
    # creative commons by address or sentence
    ("creativecommons", "cc-by", r"creativecommons org licenses by [1-4] [05]"),
    ("creativecommons", "cc-by-sa", r"creativecommons org licenses by sa [1-4] [05]"),
    ("creativecommons", "cc-by-nc", r"creativecommons org licenses by nc [1-4] [05]"),
    ("creativecommons", "cc-by-nd", r"creativecommons org licenses by nd [1-4] [05]"),
    ("creativecommons", "cc-by-nc-sa", r"creativecommons org licenses by nc sa [1-4] [05]"),
    ("creativecommons", "cc-by-nc-nd", r"creativecommons org licenses by nc nd [1-4] [05]"),
    ("creativecommons", "cc0-1.0", r"creativecommons org publicdomain zero 1 0"),
    ("creativecommons", "public-domain", r"creativecommons org publicdomain mark 1 0"),
    ("commons", "cc-by-sa", r"text is available under the creative commons attribution share ?alike license"),
    ("attribution", "cc-by", r"you must give appropriate credit provide a link to the license and indicate if changes were made (?:\S+ ){0,40}attribution|attribution you must give appropriate credit"),
    ("sharealike", "cc-by-sa", r"sharealike if you remix transform or build upon the material"),
    ("noncommercial", "cc-by-nc", r"noncommercial you may not use the material for commercial purposes"),
    # addresses of licence texts
    ("opensource", "mit", r"opensource org licenses mit"),
    ("opensource", "bsd-2-clause", r"opensource org licenses bsd 2 clause"),
    ("opensource", "bsd-3-clause", r"opensource org licenses bsd 3 clause"),
    ("opensource", "isc", r"opensource org licenses isc"),
    ("opensource", "mpl-2.0", r"opensource org licenses mpl 2 0"),
    ("gnu", "gpl-2.0", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gnu", "gpl-3.0", r"gnu org licenses gpl 3 0"),
    ("gnu", "lgpl-2.1", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("gnu", "lgpl-3.0", r"gnu org licenses lgpl 3 0"),
    ("gnu", "agpl-3.0", r"gnu org licenses agpl 3 0"),
    ("mozilla", "mpl-2.0", r"mozilla org mpl 2 0"),
    ("eclipse", "epl", r"eclipse org legal epl v\d+"),
    ("boost", "bsl-1.0", r"boost org license 1 0"),
    ("scripts", "ofl-1.1", r"scripts sil org ofl"),
    ("unlicense", "unlicense", r"unlicense org"),
    # warranty, restrictions, notices
    ("warranty", "warranty-disclaimer", r"(?:provided|distributed) as is (?:and )?without (?:any )?warranty of any kind"),
    ("merchantability", "warranty-disclaimer", r"without even the implied warranty of merchantability"),
    ("merchantability", "warranty-disclaimer", r"warranties of merchantability fitness for a particular purpose and non ?infringement"),
    ("consequential", "warranty-disclaimer", r"indirect incidental special exemplary or consequential damages"),
    ("rights", "all-rights-reserved", r"all rights reserved"),
    ("rights", "some-rights-reserved", r"some rights reserved"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("unauthorized", "proprietary", r"unauthorized (?:copying|reproduction|distribution) of this (?:file|document|software|material)"),
    ("confidential", "proprietary", r"confidential and proprietary(?: information)?"),
    ("reproduced", "proprietary", r"no part of this (?:publication|book|document|work) may be reproduced"),
    ("reverse", "proprietary", r"you may not reverse engineer decompile or disassemble"),
    ("evaluation", "evaluation", r"for evaluation purposes only"),
    ("educational", "educational", r"for educational (?:use|purposes) only"),
    ("research", "research-only", r"for (?:academic )?research (?:use|purposes) only"),
    ("commercial", "non-commercial", r"for non commercial (?:use|purposes) only"),
    ("noncommercial", "non-commercial", r"for noncommercial (?:use|purposes) only"),
    ("personal", "personal-use", r"for personal use only"),
    ("copyright", "copyright-notice", r"copyright (?:c )?(?:19|20)\d\d"),
    ("copyrighted", "copyright-notice", r"copyrighted by (?:\S+ ){0,3}(?:19|20)\d\d"),
]

#: May stand before a name.
GRANT = r"(?:licensed|released|distributed|available|published|provided|shared|covered|governed|redistributed) (?:\S+ ){0,3}?(?:under|by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:an? )?"
TAG = r"spdx license identifier "


def signatures() -> list[tuple[str, int, float, tuple[str, ...], str]]:
    """All rules in order: (label, priority of a bare match, its weight, words, regex)."""
    out = []
    for words, rules in FAMILIES:
        for label, name in rules:
            tag = label.replace("-", " ").replace(".", " ")
            regex = f"{TAG}(?:{name}|{tag})(?: only| or later)?|(?:{GRANT})?{name}"
            out.append((label, 2 if any(c.isdigit() for c in label) else 1, 0.6, (*words, "spdx"), regex))
    return out + [(label, 3, 0.8, (word,), text) for word, label, text in TEXTS]
