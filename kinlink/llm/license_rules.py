"""The signatures of licenses. Patterns are over lower-case words with one blank between; a group is the part that counts as found.

A rule is (label, keywords, priority, confidence, pattern); every match of the pattern has one of the keywords as a word.
"""

from __future__ import annotations

#: label, keyword of a text of the license or of its notice, what it says. Hand-written from the public texts.
STATEMENTS = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial", "the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", "merchantability", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", "dealings", "the software or the use or other dealings in the software"),
    ("x11", "consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", "hereby", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", "the software is provided as is and (?:the author|isc) disclaims all warranties"),
    ("0bsd", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("postgresql", "agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("hpnd-sell", "sell", "permission to use copy modify distribute and sell this software and its documentation for any purpose"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", "redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd", "warranties", "this software is provided by (?:the )?(?:copyright holders?|regents|authors?|foundation)(?: or|) ?(?:and contributors )?as is and any express or implied warranties"),
    ("bsd", "consequential", "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"),
    ("bsd-3-clause", "endorse", "neither the names? of (?:[a-z0-9]+ ){1,12}(?:may|nor the names of its contributors may) be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("zlib", "liable", "in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("bsl", "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("ncsa", "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("curl", "curl", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice(?: .{0,80})? curl"),
    ("apache", "compliance", "you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache", "applicable", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", "governing", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache", "asf", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", "apache", "the apache software foundation(?: .{0,60})? all rights reserved"),
    ("apache", "apache", "this product includes software developed by the apache software foundation"),
    ("gpl", "redistribute", "this (?:program|software|file|package) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "received", "you should have received a copy of the gnu general public license"),
    ("gpl", "hope", "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", "welcome", "this is free software and you are welcome to redistribute it under certain conditions"),
    ("gpl", "freedom", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("lgpl", "redistribute", "this (?:library|program|software) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", "received", "you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl", "lesser", "see the gnu lesser general public license"),
    ("agpl", "affero", "redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", "affero", "you should have received a copy of the gnu affero general public license"),
    ("gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl", "alternatively", "alternatively the contents of this file may be used under the terms of either the gnu general public license"),
    ("epl", "eclipse", "(?:this program and the accompanying materials are|all rights reserved this program and the accompanying materials are) made available under the terms of the eclipse public license"),
    ("cpl", "common", "made available under the terms of the common public license"),
    ("cddl", "development", "the contents of this file are subject to the terms of (?:either the gnu general public license version 2 only gpl or )?the common development and distribution license"),
    ("eupl", "eupl", "licensed under the eupl"),
    ("cecill", "cecill", "this software is governed by the cecill (?:b |c )?license under french law"),
    ("artistic", "artistic", "you can redistribute it and or modify it under (?:the terms of )?the artistic license"),
    ("perl", "perl", "(?:this (?:program|library|module) is free software )?you can redistribute it and or modify it under the same terms as perl itself"),
    ("python", "psf", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("ofl", "font", "this font software is licensed under the sil open font license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", "waived", "(?:has|have) waived all copyright and related or neighboring rights"),
    ("cc0", "dedicated", "dedicated all copyright and related and neighboring rights to (?:this software|the work) to the public domain worldwide"),
    ("wtfpl", "fuck", "do what the fuck you want to(?: public license)?"),
    ("beerware", "beer", "as long as you retain this notice you can do whatever you want with this stuff if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("public-domain", "domain", "this (?:file|work|code|software|program) is (?:hereby )?(?:in|released into|placed in|dedicated to) the public domain"),
    ("cc-by", "attribution", "this work is licensed under (?:a |the )?creative commons attribution (?:[0-9] [0-9] )?(?:international |unported |generic )?licen[sc]e"),
    ("cc-by-sa", "attribution", "this work is licensed under (?:a |the )?creative commons attribution share ?alike"),
    ("cc-by-nc", "noncommercial", "this work is licensed under (?:a |the )?creative commons attribution noncommercial"),
    ("ms-pl", "microsoft", "this license governs use of the accompanying software(?: .{0,120})? microsoft"),
    ("oracle-bcl", "oracle", "oracle binary code license agreement"),
    ("sspl", "service", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl", "licensor", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("commons-clause", "sell", "the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("libpng", "libpng", "this copy of the libpng notices is provided for your convenience"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("openssl", "eric", "this product includes cryptographic software written by eric young"),
    ("unicode", "unicode", "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("w3c", "w3c", "by obtaining using and or copying this work you the licensee agree(?: .{0,200})? w3c"),
    ("ijg", "jpeg", "this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", "portions of this software are copyright(?: .{0,40})? the freetype project"),
    ("php", "php", "this product includes php(?: software)? freely available from"),
    ("vim", "vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("tcl", "authors", "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("proprietary", "proprietary", "(?:this (?:software|file|document|program) is|contains) (?:the )?(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "prohibited", "unauthorized (?:copying|use|distribution) of this (?:file|software|document) (?:[a-z]+ ){0,6}is strictly prohibited"),
    ("all-rights-reserved", "reserved", "copyright (?:c )?(?:[0-9]{4} )(?:[0-9]{4} )?(?:[a-z0-9]+ ){1,8}all rights reserved"),
]

#: label, address as words.
ADDRESSES = [
    ("mit", "opensource org licenses mit"), ("mit", "opensource org license mit"), ("mit", "mit license org"), ("mit", "choosealicense com licenses mit"),
    ("isc", "opensource org licenses isc"), ("0bsd", "opensource org licenses 0bsd"), ("bsd-2-clause", "opensource org licenses bsd 2 clause"), ("bsd-3-clause", "opensource org licenses bsd 3 clause"), ("bsd", "opensource org licenses bsd license"),
    ("apache", "apache org licenses license 2 0"), ("apache", "apache org licenses license 1 1"), ("apache", "apache org licenses"), ("apache", "opensource org licenses apache 2 0"), ("apache", "choosealicense com licenses apache 2 0"),
    ("gpl", "gnu org licenses gpl"), ("gpl", "gnu org copyleft gpl"), ("gpl", "gnu org licenses old licenses gpl 2 0"), ("gpl", "opensource org licenses gpl"), ("gpl", "fsf org licensing licenses gpl"),
    ("lgpl", "gnu org licenses lgpl"), ("lgpl", "gnu org copyleft lesser"), ("lgpl", "gnu org licenses old licenses lgpl 2 1"), ("lgpl", "opensource org licenses lgpl"), ("agpl", "gnu org licenses agpl"), ("gfdl", "gnu org licenses fdl"),
    ("mpl", "mozilla org mpl"), ("mpl", "mozilla org en us mpl"), ("epl", "eclipse org legal epl"), ("epl", "eclipse org org documents epl"), ("cddl", "opensource org licenses cddl1"), ("cddl", "glassfish java net public cddl"),
    ("cc-by", "creativecommons org licenses by"), ("cc-by-sa", "creativecommons org licenses by sa"), ("cc-by-nc", "creativecommons org licenses by nc"), ("cc-by-nd", "creativecommons org licenses by nd"), ("cc-by-nc-sa", "creativecommons org licenses by nc sa"), ("cc-by-nc-nd", "creativecommons org licenses by nc nd"),
    ("cc0", "creativecommons org publicdomain zero"), ("public-domain", "creativecommons org publicdomain mark"), ("unlicense", "unlicense org"), ("wtfpl", "wtfpl net"), ("zlib", "zlib net zlib license"), ("zlib", "opensource org licenses zlib"),
    ("bsl", "boost org license 1 0"), ("bsl", "boost org license"), ("artistic", "perlfoundation org artistic license"), ("artistic", "opensource org licenses artistic license"), ("psf", "docs python org license"), ("php", "php net license"), ("ofl", "scripts sil org ofl"), ("ofl", "openfontlicense org"),
    ("odbl", "opendatacommons org licenses odbl"), ("odc-by", "opendatacommons org licenses by"), ("pddl", "opendatacommons org licenses pddl"), ("ms-pl", "opensource org licenses ms pl"), ("ms-pl", "microsoft com opensource licenses"), ("sspl", "mongodb com licensing server side public license"), ("busl", "mariadb com bsl11"),
    ("eupl", "joinup ec europa eu collection eupl"), ("cecill", "cecill info"), ("elastic", "elastic co licensing elastic license"), ("llama", "ai meta com llama license"), ("openrail", "huggingface co spaces bigscience license"), ("polyform", "polyformproject org licenses"), ("ogl", "nationalarchives gov uk doc open government licence"),
]

#: SPDX identifiers as words, by label. An "only", "or later" or exception after them belongs to the match.
IDENTIFIERS = {
    "mit": ("mit", "mit cmu", "mit feh", "mit modern variant", "mit open group"), "mit-0": ("mit 0",), "mit-advertising": ("mit advertising",), "x11": ("x11",), "isc": ("isc",), "0bsd": ("0bsd",),
    "bsd-1-clause": ("bsd 1 clause",), "bsd-2-clause": ("bsd 2 clause", "bsd 2 clause patent", "bsd 2 clause views", "freebsd doc"), "bsd-3-clause": ("bsd 3 clause", "bsd 3 clause clear", "bsd 3 clause attribution", "bsd 3 clause lbnl", "bsd 3 clause no nuclear license"), "bsd-4-clause": ("bsd 4 clause", "bsd 4 clause uc"), "bsd": ("bsd protection", "bsd source code"),
    "apache": ("apache 1 0", "apache 1 1", "apache 2 0"), "gpl": ("gpl 1 0", "gpl 2 0", "gpl 3 0"), "lgpl": ("lgpl 2 0", "lgpl 2 1", "lgpl 3 0", "lgpllr"), "agpl": ("agpl 1 0", "agpl 3 0"), "gfdl": ("gfdl 1 1", "gfdl 1 2", "gfdl 1 3"),
    "mpl": ("mpl 1 0", "mpl 1 1", "mpl 2 0", "mpl 2 0 no copyleft exception"), "epl": ("epl 1 0", "epl 2 0"), "cddl": ("cddl 1 0", "cddl 1 1"), "cpl": ("cpl 1 0",), "eupl": ("eupl 1 0", "eupl 1 1", "eupl 1 2"), "ipl": ("ipl 1 0",), "cpal": ("cpal 1 0",), "rpl": ("rpl 1 1", "rpl 1 5"), "apsl": ("apsl 1 0", "apsl 1 1", "apsl 1 2", "apsl 2 0"),
    "cc-by": ("cc by 1 0", "cc by 2 0", "cc by 2 5", "cc by 3 0", "cc by 4 0"), "cc-by-sa": ("cc by sa 1 0", "cc by sa 2 0", "cc by sa 2 5", "cc by sa 3 0", "cc by sa 4 0"), "cc-by-nc": ("cc by nc 1 0", "cc by nc 2 0", "cc by nc 2 5", "cc by nc 3 0", "cc by nc 4 0"), "cc-by-nd": ("cc by nd 1 0", "cc by nd 2 0", "cc by nd 2 5", "cc by nd 3 0", "cc by nd 4 0"),
    "cc-by-nc-sa": ("cc by nc sa 1 0", "cc by nc sa 2 0", "cc by nc sa 2 5", "cc by nc sa 3 0", "cc by nc sa 4 0"), "cc-by-nc-nd": ("cc by nc nd 1 0", "cc by nc nd 2 0", "cc by nc nd 2 5", "cc by nc nd 3 0", "cc by nc nd 4 0"), "cc0": ("cc0 1 0",),
    "unlicense": ("unlicense",), "wtfpl": ("wtfpl",), "beerware": ("beerware",), "zlib": ("zlib", "zlib acknowledgement"), "libpng": ("libpng", "libpng 2 0"), "bsl": ("bsl 1 0",), "busl": ("busl 1 1",), "artistic": ("artistic 1 0", "artistic 1 0 perl", "artistic 1 0 cl8", "artistic 2 0"), "psf": ("psf 2 0", "python 2 0", "python 2 0 1"), "php": ("php 3 0", "php 3 01"),
    "openssl": ("openssl",), "ofl": ("ofl 1 0", "ofl 1 1", "ofl 1 1 rfn", "ofl 1 1 no rfn"), "odbl": ("odbl 1 0",), "odc-by": ("odc by 1 0",), "pddl": ("pddl 1 0",), "ms-pl": ("ms pl",), "ms-rl": ("ms rl",), "sspl": ("sspl 1 0",), "ncsa": ("ncsa",), "ecl": ("ecl 1 0", "ecl 2 0"), "afl": ("afl 1 1", "afl 1 2", "afl 2 0", "afl 2 1", "afl 3 0"), "osl": ("osl 1 0", "osl 1 1", "osl 2 0", "osl 2 1", "osl 3 0"),
    "vim": ("vim",), "postgresql": ("postgresql",), "curl": ("curl",), "hpnd": ("hpnd", "hpnd sell variant"), "unicode": ("unicode dfs 2015", "unicode dfs 2016", "unicode 3 0", "unicode tou"), "w3c": ("w3c", "w3c 19980720", "w3c 20150513"), "ijg": ("ijg",), "freetype": ("ftl",), "json": ("json",), "icu": ("icu",), "tcl": ("tcl",), "ruby": ("ruby",), "cecill": ("cecill 1 0", "cecill 2 0", "cecill 2 1", "cecill b", "cecill c"),
    "upl": ("upl 1 0",), "bluoak": ("blueoak 1 0 0",), "mulan": ("mulanpsl 1 0", "mulanpsl 2 0"), "elastic": ("elastic 2 0",), "polyform": ("polyform noncommercial 1 0 0", "polyform small business 1 0 0"), "ogl": ("ogl uk 1 0", "ogl uk 2 0", "ogl uk 3 0"), "qpl": ("qpl 1 0",), "sleepycat": ("sleepycat",), "zpl": ("zpl 1 1", "zpl 2 0", "zpl 2 1"), "nposl": ("nposl 3 0",),
}
EXCEPTIONS = "(?: with (?:classpath|gcc|llvm|autoconf|bison|font|linux syscall|openssl|ocaml lgpl linking|universal foss|u boot|wxwindows)(?: [a-z0-9]+){0,4}? ?(?:exception|note)(?: [0-9](?: [0-9])?)?)?"

#: Short names as they stand in prose and metadata: label, keywords, pattern.
SHORT = [
    ("gpl", "gplv1 gplv2 gplv3", "(?:gnu )?gplv[123](?: 0)?(?: or later| only| plus)?"), ("gpl", "gpl", "(?:gnu )?gpl v(?:ersion )?[123](?: 0)?(?: or later| only)?"), ("gpl", "gpl2 gpl3", "gpl[23](?: or later)?"), ("gpl", "gpl", "gpl [23] 0 (?:or later|only)"),
    ("gpl", "gpl", "(?:the |gnu )gpl licen[sc]e"), ("gpl", "gpl", "under (?:the )?(?:gnu )?gpl"), ("lgpl", "lgplv2 lgplv3", "(?:gnu )?lgplv[23](?: [01])?(?: or later| only)?"), ("lgpl", "lgpl", "(?:gnu )?lgpl v(?:ersion )?[23](?: [01])?"), ("lgpl", "lgpl2 lgpl3", "lgpl[23](?: [01])?"), ("lgpl", "lgpl", "under (?:the )?(?:gnu )?lgpl"),
    ("agpl", "agplv3", "(?:gnu )?agplv3(?: or later| only)?"), ("agpl", "agpl3", "agpl3"), ("agpl", "agpl", "under (?:the )?(?:gnu )?agpl"), ("apache", "apache2 apachev2", "apachev?2(?: 0)?(?: licen[sc]e)?"), ("apache", "asl", "asl (?:version |v)?(?:2 0|1 1)"), ("apache", "aslv2 asl2", "aslv?2(?: 0)?"), ("apache", "apache", "apache v?2(?: 0)? licen[sc]ed?"), ("apache", "apache", "under (?:the )?apache(?: licen[sc]e)?(?: v?2(?: 0)?)?"),
    ("apache", "apache", "apache licen[sc]e(?: version)? (?:v ?)?(?:2 0|1 1|2)"), ("mit", "mit", "mit licen[sc]ed"), ("mit", "mit", "under (?:the )?mit"), ("mit", "expat", "expat licen[sc]e"), ("mit", "mit", "mit style licen[sc]e"), ("mit", "mit", "mit x11 licen[sc]e"), ("bsd", "bsd", "bsd (?:style|like) licen[sc]e"), ("bsd", "bsd", "bsd licen[sc]ed"), ("bsd", "bsd", "under (?:the |a )?bsd(?! [1234] clause)"),
    ("bsd-2-clause", "bsd2", "bsd2"), ("bsd-3-clause", "bsd3", "bsd3"), ("bsd-2-clause", "bsd", "(?:two|2) clause bsd(?: licen[sc]e)?"), ("bsd-3-clause", "bsd", "(?:three|3) clause bsd(?: licen[sc]e)?"), ("bsd-4-clause", "bsd", "(?:four|4) clause bsd(?: licen[sc]e)?"), ("bsd-2-clause", "freebsd", "freebsd licen[sc]e"), ("bsd-3-clause", "revised", "revised bsd(?: licen[sc]e)?"),
    ("mpl", "mplv1 mplv2", "mplv[12](?: [01])?"), ("mpl", "mpl2", "mpl2(?: 0)?"), ("epl", "epl", "epl v?[12](?: 0)?"), ("epl", "eplv1 eplv2", "eplv[12](?: 0)?"), ("cddl", "cddl", "cddl (?:v|version )?1 [01]"), ("cddl", "cddl", "under (?:the )?cddl"), ("eupl", "eupl", "eupl v?1 [012]"), ("eupl", "eupl", "under (?:the )?eupl"),
    ("cc-by", "ccby", "ccby"), ("cc-by", "cc", "under cc by(?! (?:sa|nc|nd))"), ("cc0", "cc0", "under (?:a )?cc0(?: licen[sc]e)?"), ("cc0", "zero", "creative commons zero"), ("unlicense", "unlicense", "under the unlicense"), ("wtfpl", "wtfpl", "under (?:the )?wtfpl"), ("bsl", "bsl", "under (?:the )?bsl"), ("zlib", "zlib", "under (?:the )?zlib"), ("isc", "isc", "under (?:the )?isc"),
    ("postgresql", "postgresql", "postgresql licen[sc]e"), ("unicode", "unicode", "unicode licen[sc]e(?: v3)?"), ("beerware", "beerware beer", "beer ?ware licen[sc]e"), ("upl", "universal", "universal permissive licen[sc]e"), ("elastic", "elastic", "elastic licen[sc]e(?: 2 0| v2)?"), ("mulan", "mulan", "mulan permissive software licen[sc]e"), ("ogl", "government", "open government licen[sc]e"), ("cecill", "cecill", "cecill(?: b| c)? licen[sc]e"),
    ("qpl", "q", "q public licen[sc]e"), ("ipl", "ibm", "ibm public licen[sc]e"), ("zpl", "zope", "zope public licen[sc]e"), ("ruby", "ruby", "ruby licen[sc]e"), ("apsl", "apple", "apple public source licen[sc]e"), ("sleepycat", "sleepycat", "sleepycat licen[sc]e"), ("polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict) licen[sc]e"), ("gemma", "gemma", "gemma terms of use"), ("cc-by-sa", "cc", "under cc by sa"), ("pddl", "dedication", "public domain dedication and licen[sc]e"),
]


def hand_written() -> list[tuple[str, str, int, float, str]]:
    """All rules of this module; the longer a text that has to stand, the surer it is."""
    out = [(label, key, 6, min(0.99, 0.8 + len(text) / 400), text) for label, key, text in STATEMENTS]
    out += [(label, text.split()[0], 5, 0.95, f"(?:https? )?(?:www )?{text}(?: v?[0-9](?: [0-9])?)?(?: html| txt| php)?") for label, text in ADDRESSES]
    out += [(label, keys, 3, 0.85, text) for label, keys, text in SHORT]
    after = f"(?: only| or later| plus)?{EXCEPTIONS}"
    for label, every in IDENTIFIERS.items():
        for words in every:
            out.append((label, "spdx", 7, 0.99, f"spdx license identifiers? (?:(?:[a-z0-9]+ ){{1,16}}?(?:or|and) )?({words}{after})"))
            out.append((label, words.split()[0], 4, 0.8, f"licen[sc]es? (?:expression |identifier |name |osi approved |type |id )?({words}{after})(?! licen[sc]e)"))
    return out
