"""License scan by ordered signature rules, in DataFrame functions only.

A text that shows no keyword costs two regex scans. Others are normalised to lower-case words between single spaces;
each rule whose family keyword occurs is matched on them; a match that lies inside another rule's match of the same or
a higher priority is suppressed, so that "gnu lesser general public license version 2 1" is one finding and not three.
Everything happens within a row: nothing is shuffled.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .quality import let

#: Between words, where A-Z count as letters (they are lower-cased first).
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases whose places are always reported.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
FOUND = "array<struct<label:string,priority:int,first:int,last:int>>"
#: Stands before the first word of a match; no normalised text holds it.
MARK = "\x01"
_V = r"(?: (?:version|ver|v))? v?"
_LATER = r"(?: (?:or|and)(?: at your option)?(?: any)? (?:later|newer)(?: version)?)?"

# family keyword -> [(label, priority, regex of words)]; {v} and the space behind it stand for an optional "version"
FAMILIES: dict[str, list[tuple[str, int, str]]] = {
    "apache": [
        ("apache", 60, "apache (?:software )?licen[cs]e"),
        *((f"apache-{a}.{b}", 80, rf"apache(?: software)? licen[cs]e{{v}} {a} {b}") for a, b in ((1, 0), (1, 1), (2, 0))),
        ("apache-2.0", 70, "apache 2(?: 0)?(?: licen[cs]e)?"),
        ("apache-2.0", 75, "licensed under the apache licen[cs]e{v} 2(?: 0)? the license"),
    ],
    "except in compliance": [("apache-2.0", 90, "you may not use this (?:file|work|software) except in compliance with the license")],
    "mit ": [
        ("mit", 60, "(?:the )?mit licen[cs]e"),
        ("mit", 70, "(?:released|licensed|distributed|available|published) under (?:the )?(?:terms of the )?(?:an )?mit(?: expat)? licen[cs]e"),
        ("mit-0", 85, "mit no attribution(?: licen[cs]e)?"),
    ],
    "permission": [
        ("mit", 95, "permission is hereby granted free of charge to any person obtaining a copy of this software"),
        ("isc", 95, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
        ("hpnd", 80, "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ],
    "x consortium": [("x11", 85, "except as contained in this notice the name of the x consortium shall not be used")],
    "redistribution": [
        ("bsd", 80, "redistribution and use in source and binary forms with or without modification are permitted"),
        ("bsd-2-clause", 90, "redistributions in binary form must reproduce the above copyright notice"),
    ],
    "neither the name": [("bsd-3-clause", 95, r"neither the name(?:s)? of (?:the )?(?:\S+ ){1,12}?nor the names of (?:its|their) contributors")],
    "advertising": [("bsd-4-clause", 95, "all advertising materials mentioning features or use of this software must display")],
    "bsd": [
        ("bsd", 60, "bsd(?: style)? licen[cs]e"),
        *((f"bsd-{n}-clause", 80, f"(?:bsd {w} clause|{w} clause bsd)(?: licen[cs]e)?") for n, w in ((0, "(?:0|zero)"), (1, "(?:1|one)"), (2, "(?:2|two)"), (3, "(?:3|three)"), (4, "(?:4|four)"))),
        ("bsd-2-clause", 85, "(?:simplified|freebsd) bsd licen[cs]e"),
        ("bsd-3-clause", 85, "(?:new|modified|revised) bsd licen[cs]e"),
    ],
    "general public": [
        ("gpl", 65, "gnu general public licen[cs]e"),
        *((f"{l}-{n}", 80, f"gnu {w}general public licen[cs]e{{v}} {n.replace('.', ' ')}{_LATER}") for (l, w, vs) in (("gpl", "", ("1", "2", "3")), ("lgpl", "(?:lesser|library) ", ("2", "2.1", "3")), ("agpl", "affero ", ("1", "3"))) for n in vs),
        ("lgpl", 70, "(?:gnu )?(?:lesser|library) general public licen[cs]e"),
        ("agpl", 70, "(?:gnu )?affero general public licen[cs]e"),
        ("gpl", 75, "under the terms of the (?:gnu )?general public licen[cs]e"),
    ],
    "free software": [
        ("gpl", 70, "this (?:program|library) is free software you can redistribute it and or modify"),
        ("fsf", 40, "free software foundation(?: inc)?"),
    ],
    "gpl": [(f"{l}{'-' + n if n else ''}", 70 if n else 55, f"{l}{' ?(?:v|version)? ?' + n.replace('.', ' ') if n else ''}{_LATER}") for l, vs in (("gpl", ("", "1", "2", "3")), ("lgpl", ("", "2", "2.1", "3")), ("agpl", ("", "1", "3"))) for n in vs],
    "mozilla": [("mpl", 65, "mozilla public licen[cs]e"), *((f"mpl-{n}", 80, f"mozilla public licen[cs]e{{v}} {n.replace('.', ' ')}") for n in ("1.0", "1.1", "2.0")), ("mpl-2.0", 95, "this source code form is subject to the terms of the mozilla public license v 2 0")],
    "eclipse": [("epl", 65, "eclipse public licen[cs]e"), *((f"epl-{n}", 80, f"eclipse public licen[cs]e{{v}} {n.replace('.', ' ')}") for n in ("1.0", "2.0")), ("edl-1.0", 80, "eclipse distribution licen[cs]e(?:{v} 1 0)?")],
    "european union": [("eupl", 65, "european union public licen[cs]e"), *((f"eupl-{n}", 80, f"european union public licen[cs]e{{v}} {n.replace('.', ' ')}") for n in ("1.0", "1.1", "1.2"))],
    "creative commons": [
        ("cc", 50, "creative commons"),
        *((f"cc-{'-'.join(p)}", 75, "creative commons " + " ".join({"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative|s|atives)?(?: works)?"}[x] for x in p)) for p in (("by",), ("by", "nc"), ("by", "sa"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd"))),
        ("cc0-1.0", 80, "creative commons zero(?: v)?(?: 1 0)?(?: universal)?"),
    ],
    "cc": [
        *((f"cc-{'-'.join(p)}-{v}.{w}", 80, f"cc {' '.join(p)} {v} {w}(?: (?:international|unported|generic))?") for p, (v, w) in product((("by",), ("by", "nc"), ("by", "sa"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd")), ((1, 0), (2, 0), (2, 5), (3, 0), (4, 0)))),
        *((f"cc-{'-'.join(p)}", 70, f"cc {' '.join(p)}") for p in (("by", "nc"), ("by", "sa"), ("by", "nd"), ("by", "nc", "sa"), ("by", "nc", "nd"))),
        ("cc0-1.0", 80, "cc0(?: 1 0)?(?: universal)?"),
    ],
    "public domain": [("public-domain", 60, "public domain"), ("public-domain", 70, "(?:released|dedicated|placed) (?:in|into|to) the public domain"), ("unlicense", 95, "this is free and unencumbered software released into the public domain")],
    "unlicense": [("unlicense", 70, "(?:the )?unlicense")],
    "boost": [("bsl-1.0", 80, "boost software licen[cs]e(?:{v} 1 0)?")],
    "artistic": [("artistic", 65, "artistic licen[cs]e"), *((f"artistic-{n}", 80, f"artistic licen[cs]e{{v}} {n.replace('.', ' ')}") for n in ("1.0", "2.0"))],
    "zlib": [("zlib", 75, "zlib(?: libpng)? licen[cs]e")],
    "as is": [("zlib", 90, "this software is provided as is without any express or implied warranty in no event will the authors be held liable"), ("warranty-disclaimer", 50, "(?:is )?provided (?:by the copyright holders and contributors )?as is")],
    "isc": [("isc", 70, "isc licen[cs]e")],
    "what the": [("wtfpl", 80, "do what the (?:fuck|f k) you want to public licen[cs]e")],
    "python": [("psf-2.0", 75, "python software foundation licen[cs]e(?:{v} 2)?"), ("python-2.0", 75, "python licen[cs]e(?:{v} 2 0)?")],
    "academic free": [("afl", 65, "academic free licen[cs]e"), *((f"afl-{n}", 80, f"academic free licen[cs]e{{v}} {n.replace('.', ' ')}") for n in ("1.1", "1.2", "2.0", "2.1", "3.0"))],
    "open software": [("osl", 65, "open software licen[cs]e"), *((f"osl-{n}", 80, f"open software licen[cs]e{{v}} {n.replace('.', ' ')}") for n in ("1.0", "2.0", "2.1", "3.0"))],
    "common development": [("cddl", 65, "common development and distribution licen[cs]e"), *((f"cddl-{n}", 80, f"common development and distribution licen[cs]e(?: cddl)?{{v}} {n.replace('.', ' ')}") for n in ("1.0", "1.1"))],
    "open font": [("ofl", 65, "(?:sil )?open font licen[cs]e"), ("ofl-1.1", 80, "(?:sil )?open font licen[cs]e{v} 1 1")],
    "open database": [("odbl-1.0", 75, "open database licen[cs]e(?:{v} 1 0)?")],
    "open data commons": [("odc-by-1.0", 75, "open data commons attribution licen[cs]e(?:{v} 1 0)?"), ("pddl-1.0", 75, "open data commons public domain dedication(?: and)? licen[cs]e")],
    "free documentation": [("gfdl", 65, "(?:gnu )?free documentation licen[cs]e"), *((f"gfdl-{n}", 80, f"(?:gnu )?free documentation licen[cs]e{{v}} {n.replace('.', ' ')}{_LATER}") for n in ("1.1", "1.2", "1.3"))],
    "microsoft": [("ms-pl", 75, "microsoft public licen[cs]e"), ("ms-rl", 75, "microsoft reciprocal licen[cs]e")],
    "business source": [("busl-1.1", 75, "business source licen[cs]e(?:{v} 1 1)?")],
    "server side": [("sspl-1.0", 75, "server side public licen[cs]e(?:{v} 1)?")],
    "elastic": [("elastic-2.0", 75, "elastic licen[cs]e(?:{v} 2 0)?")],
    "open government": [("ogl", 65, "open government licen[cs]e"), *((f"ogl-{n}", 80, f"open government licen[cs]e{{v}} {n}(?: 0)?") for n in ("1", "2", "3"))],
    "applicable law": [("apache-2.0", 90, "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis")],
    "use reproduction": [("apache-2.0", 85, "terms and conditions for use reproduction and distribution")],
    "january 2004": [("apache-2.0", 95, "apache licen[cs]e version 2 0 january 2004")],
    "royalty free": [
        ("apache-2.0", 90, "a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e"),
        ("apache-2.0", 90, "a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent licen[cs]e"),
        ("cc-by", 60, "a worldwide royalty free non exclusive perpetual for the duration of the applicable copyright licen[cs]e"),
        ("mpl", 60, "hereby grants you a world ?wide royalty free non exclusive licen[cs]e"),
    ],
    "without restriction": [("mit", 95, "to deal in the software without restriction including without limitation the rights")],
    "substantial portions": [("mit", 90, "(?:this|the above) (?:copyright|permission) notice(?: and this permission notice)? shall be included in all copies or substantial portions of the software")],
    "warranty of any kind": [("mit", 80, "the software is provided as is without warranty of any kind express or implied"), ("warranty-disclaimer", 40, "without (?:any )?warranty of any kind")],
    "claim damages": [("mit", 85, "in no event shall the authors or copyright holders be liable for any claim damages or other liability")],
    "expat": [("mit", 75, "expat licen[cs]e")],
    "must retain": [("bsd", 90, "redistributions of source code must retain the above copyright notice")],
    "endorse or promote": [("bsd-3-clause", 90, "be used to endorse or promote products derived from this software without specific prior written permission")],
    "consequential damages": [("bsd", 80, "be liable for any direct indirect incidental special exemplary or consequential damages")],
    "patent rights": [("bsd-3-clause-clear", 95, "no express or implied licen[cs]es to any party s patent rights are granted by this licen[cs]e")],
    "nuclear facility": [("bsd-3-clause-no-nuclear", 95, "construction operation or maintenance of any nuclear facility")],
    "regents": [("bsd", 70, "the regents of the university of california")],
    "disclaims all warranties": [("isc", 90, "the author disclaims all warranties with regard to this software")],
    "in the hope": [
        ("gpl", 80, "this program is distributed in the hope that it will be useful but without any warranty"),
        ("lgpl", 80, "this library is distributed in the hope that it will be useful but without any warranty"),
        ("warranty-disclaimer", 45, "distributed in the hope that it will be useful"),
    ],
    "should have received": [
        ("gpl", 85, "you should have received a copy of the gnu general public licen[cs]e along with this (?:program|library|software)"),
        ("lgpl", 85, "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this (?:program|library|software)"),
        ("agpl", 85, "you should have received a copy of the gnu affero general public licen[cs]e along with this (?:program|library|software)"),
        ("cc0-1.0", 85, "you should have received a copy of the cc0 public domain dedication"),
    ],
    "at your option": [("gpl-2.0-or-later", 85, "either version 2 of the licen[cs]e or at your option any later version"), ("lgpl-2.1-or-later", 85, "either version 2 1 of the licen[cs]e or at your option any later version"), ("gpl-3.0-or-later", 85, "either version 3 of the licen[cs]e or at your option any later version")],
    "distribute verbatim": [("fsf", 60, "everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed"), ("wtfpl", 80, "everyone is permitted to copy and distribute verbatim or modified copies of this licen[cs]e document")],
    "copyleft": [("gpl-3.0", 95, "the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works"), ("agpl-3.0", 95, "the gnu affero general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works"), ("copyleft-next", 80, "copyleft next(?: 0 3 [01])?")],
    "freedom to share": [("gpl-2.0", 90, "designed to take away your freedom to share and change it")],
    "remote network": [("agpl-3.0", 90, "remote network interaction use with the gnu general public licen[cs]e")],
    "computer network": [("agpl-3.0", 70, "interacting with it remotely through a computer network")],
    "exception": [
        ("classpath-exception", 80, "(?:gnu )?classpath exception"), ("gcc-exception", 80, "gcc runtime library exception"), ("autoconf-exception", 80, "autoconf(?: configure script)? exception"), ("bison-exception", 80, "bison(?: parser)? exception"),
        ("font-exception", 80, "font embedding exception"), ("linking-exception", 75, "(?:static )?linking exception"), ("openssl-exception", 80, "openssl(?: linking)? exception"), ("llvm-exception", 85, "llvm exceptions?"), ("linking-exception", 85, "as a special exception the copyright holders of this library give you permission to link"),
    ],
    "syscall": [("linux-syscall-note", 80, "linux syscall note")],
    "secondary": [("mpl-2.0", 80, "incompatible with secondary licen[cs]es")],
    "source code form": [("mpl", 60, "source code form")],
    "the mpl": [("mpl-2.0", 85, "if a copy of the mpl was not distributed with this file")],
    "accompanying materials": [("epl", 85, "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e")],
    "font software": [("ofl-1.1", 90, "this font software is licen[cs]ed under the sil open font licen[cs]e"), ("ofl", 85, "neither the font software nor any of its individual components in original or modified versions may be sold by itself")],
    "public licen": [
        ("lppl", 75, "latex project public licen[cs]e"), ("lppl-1.3c", 85, "latex project public licen[cs]e version 1 3c"), ("zpl", 70, "zope public licen[cs]e"), ("zpl-2.1", 80, "zope public licen[cs]e{v} 2 1"), ("ipl-1.0", 75, "ibm public licen[cs]e(?:{v} 1 0)?"), ("cpl-1.0", 75, "common public licen[cs]e(?:{v} 1 0)?"),
        ("npl", 70, "netscape public licen[cs]e"), ("npl-1.1", 80, "netscape public licen[cs]e{v} 1 1"), ("qpl-1.0", 75, "q public licen[cs]e(?:{v} 1 0)?"), ("spl-1.0", 75, "sun public licen[cs]e(?:{v} 1 0)?"), ("rpl-1.5", 75, "reciprocal public licen[cs]e(?:{v} 1 5)?"), 
        ("sugarcrm-1.1.3", 75, "sugarcrm public licen[cs]e"), ("openldap", 75, "openldap public licen[cs]e"), ("cuapl-1.0", 75, "cua office public licen[cs]e"), ("lpl-1.02", 75, "lucent public licen[cs]e(?:{v} 1 02)?"), ("rscpl", 75, "ricoh source code public licen[cs]e"), ("watcom-1.0", 75, "(?:sybase )?open watcom public licen[cs]e"),
        ("ypl-1.1", 75, "yahoo public licen[cs]e"), ("apl-1.0", 75, "adaptive public licen[cs]e"), ("erlpl-1.1", 75, "erlang public licen[cs]e"), ("interbase-1.0", 75, "interbase public licen[cs]e"), ("mulanpubl-2.0", 75, "mulan public licen[cs]e"), ("opl", 70, "open public licen[cs]e"),
        ("affero-1.0", 70, "affero public licen[cs]e"), ("sissl", 60, "sun industry standards public licen[cs]e"), ("cecill-public", 50, "cecill public licen[cs]e"), ("phpl", 50, "php public licen[cs]e"), ("public-license", 15, "public licen[cs]e"),
    ],
    "public source": [("apsl", 70, "apple public source licen[cs]e"), ("apsl-2.0", 80, "apple public source licen[cs]e{v} 2 0"), ("rpsl-1.0", 75, "realnetworks public source licen[cs]e")],
    "openssl": [("openssl", 85, "this product includes software developed by the openssl project"), ("openssl", 70, "openssl licen[cs]e")],
    "php": [("php", 85, "this product includes php(?: software)? freely available from"), ("php-3.01", 75, "php licen[cs]e(?:{v} 3 0?1)?")],
    "cryptographic software": [("ssleay", 85, "this product includes cryptographic software written by eric young")],
    "ncsa": [("ncsa", 75, "(?:university of illinois )?ncsa(?: open source)? licen[cs]e")],
    "postgresql": [("postgresql", 75, "postgresql(?: database)? licen[cs]e")],
    "unicode": [("unicode", 75, "unicode(?: inc)? licen[cs]e agreement data files and software"), ("unicode-3.0", 75, "unicode licen[cs]e v3")],
    "w3c": [("w3c", 75, "w3c(?: software)?(?: notice)?(?: and)?(?: document)? licen[cs]e")],
    "universal permissive": [("upl-1.0", 80, "universal permissive licen[cs]e(?:{v} 1 0)?")],
    "mulan": [("mulanpsl-2.0", 80, "mulan (?:psl|permissive software licen[cs]e)(?: v ?2)?")],
    "cecill": [("cecill", 65, "cecill"), ("cecill-b", 75, "cecill b"), ("cecill-c", 75, "cecill c"), ("cecill-2.1", 75, "cecill(?: version)? 2 1")],
    "good not evil": [("json", 90, "the software shall be used for good not evil")],
    "beer": [("beerware", 80, "the beer ?ware licen[cs]e"), ("beerware", 90, "you can buy me a beer in return")],
    "commons clause": [("commons-clause", 80, "commons clause(?: licen[cs]e)?(?: condition)?(?: v ?1 0)?")],
    "polyform": [("polyform-noncommercial-1.0.0", 80, "polyform non ?commercial licen[cs]e"), ("polyform-small-business-1.0.0", 80, "polyform small business licen[cs]e"), ("polyform-shield-1.0.0", 80, "polyform shield licen[cs]e"), ("polyform-strict-1.0.0", 80, "polyform strict licen[cs]e")],
    "change date": [("busl-1.1", 70, "on the change date(?: \\S+){0,12} the licensor hereby grants you rights under the terms of the change licen[cs]e")],
    "use grant": [("busl-1.1", 60, "additional use grant")],
    "confluent": [("confluent-community-1.0", 80, "confluent community licen[cs]e")],
    "source available": [("rsal", 80, "redis source available licen[cs]e"), ("source-available", 40, "source available licen[cs]e")],
    "timescale": [("tsl", 80, "timescale licen[cs]e")],
    "hippocratic": [("hippocratic", 75, "hippocratic licen[cs]e"), ("hippocratic-2.1", 80, "hippocratic licen[cs]e{v} 2 1"), ("hippocratic-3.0", 80, "hippocratic licen[cs]e{v} 3 0")],
    "community data": [("cdla-permissive", 75, "community data licen[cs]e agreement permissive"), ("cdla-sharing", 75, "community data licen[cs]e agreement sharing"), ("cdla", 65, "community data licen[cs]e agreement")],
    "free art": [("fal-1.3", 75, "free art licen[cs]e(?:{v} 1 3)?")],
    "art libre": [("fal-1.3", 75, "licence art libre")],
    "open publication": [("open-publication", 75, "open publication licen[cs]e")],
    "open content": [("opencontent", 75, "open content licen[cs]e")],
    "opencontent": [("opencontent", 75, "opencontent licen[cs]e")],
    "open group": [("opengroup", 75, "open group test suite licen[cs]e")],
    "jpeg group": [("ijg", 75, "independent jpeg group")],
    "info zip": [("info-zip", 75, "info zip licen[cs]e")],
    "imagemagick": [("imagemagick", 75, "imagemagick licen[cs]e")],
    "freetype": [("ftl", 75, "freetype(?: project)? licen[cs]e")],
    "vim": [("vim", 70, "vim licen[cs]e")],
    "curl": [("curl", 70, "curl licen[cs]e")],
    "bzip2": [("bzip2", 70, "bzip2(?: and libbzip2)? licen[cs]e")],
    "libtiff": [("libtiff", 70, "libtiff licen[cs]e")],
    "libpng": [("libpng", 70, "libpng licen[cs]e")],
    "png reference": [("libpng", 75, "png reference library licen[cs]e")],
    "ruby": [("ruby", 70, "ruby(?: s)? licen[cs]e")],
    "perl": [("perl", 70, "same terms as perl(?: itself)?"), ("perl", 70, "perl licen[cs]e")],
    "sleepycat": [("sleepycat", 75, "sleepycat licen[cs]e")],
    "tcl": [("tcl", 70, "tcl(?: tk)? licen[cs]e")],
    "wxwindows": [("wxwindows", 75, "wxwindows library licen[cs]e")],
    "vovida": [("vsl-1.0", 75, "vovida software licen[cs]e")],
    "eiffel": [("efl-2.0", 75, "eiffel forum licen[cs]e(?:{v} 2)?")],
    "educational community": [("ecl-2.0", 75, "educational community licen[cs]e(?:{v} 2 0)?")],
    "public attribution": [("cpal-1.0", 75, "common public attribution licen[cs]e(?:{v} 1 0)?")],
    "netizen": [("nosl", 75, "netizen open source licen[cs]e")],
    "trusted open": [("catosl-1.1", 75, "computer associates trusted open source licen[cs]e")],
    "attribution assurance": [("aal", 75, "attribution assurance licen[cs]e")],
    "open source licen": [("intel-osl", 75, "intel open source licen[cs]e"), ("jabber-osl", 75, "jabber open source licen[cs]e"), ("nokia", 75, "nokia open source licen[cs]e"), ("open-source", 20, "open source licen[cs]e")],
    "nasa open": [("nasa-1.3", 75, "nasa open source agreement(?:{v} 1 3)?"), ("nasa-1.3", 75, "nasa open source licen[cs]e")],
    "frameworx": [("frameworx-1.0", 75, "frameworx(?: open)? licen[cs]e")],
    "motosoto": [("motosoto", 75, "motosoto(?: open source)? licen[cs]e")],
    "oclc": [("oclc-2.0", 75, "oclc research public licen[cs]e")],
    "ipa font": [("ipa", 75, "ipa font licen[cs]e(?: agreement)?")],
    "ogc": [("ogc-1.0", 75, "ogc software licen[cs]e")],
    "blue oak": [("blueoak-1.0.0", 80, "blue oak model licen[cs]e(?:{v} 1 0 0)?")],
    "llama": [("llama", 75, "llama(?: \\d)? community licen[cs]e(?: agreement)?")],
    "responsible ai": [("rail", 75, "responsible ai licen[cs]es?"), ("openrail", 75, "open responsible ai licen[cs]es?")],
    "openrail": [("openrail", 75, "(?:big ?science|creativeml)? ?openrail(?: m)?")],
    "ethical source": [("ethical-source", 60, "ethical source licen[cs]e")],
    "anti capitalist": [("anti-capitalist-1.4", 75, "anti capitalist software licen[cs]e(?:{v} 1 4)?")],
    "parity": [("parity-7.0.0", 75, "parity public licen[cs]e")],
    "prosperity": [("prosperity-3.0.0", 75, "prosperity public licen[cs]e")],
    "mirtos": [("mit", 40, "mirtos licen[cs]e")],
    "miros": [("miros", 75, "miros licen[cs]e")],
    "nunit": [("nunit", 75, "nunit licen[cs]e")],
    "json licen": [("json", 75, "json licen[cs]e")],
    "net library": [("ms-net-library", 75, "microsoft (?:software licen[cs]e terms for the )?net library(?: licen[cs]e)?")],
    "end user": [("eula", 60, "end user licen[cs]e agreement")],
    "trade secret": [("proprietary", 65, "trade secret (?:and|or) (?:proprietary|confidential) information of"), ("proprietary", 65, "(?:confidential|proprietary) (?:and|or) trade secret information of")],
    "proprietary information": [("proprietary", 65, "confidential (?:and|or) proprietary information of")],
    "internal use": [("proprietary", 50, "for internal use only")],
    "evaluation": [("evaluation", 45, "for evaluation (?:purposes )?only")],
    "non commercial": [("non-commercial", 45, "for non commercial (?:use|purposes)(?: only)?"), ("cc-by-nc", 60, "attribution non commercial")],
    "attribution": [("cc-by-sa", 60, "attribution share ?alike"), ("cc-by-nd", 60, "attribution no ?deriv(?:ative|atives|s)")],
    "dual licen": [("dual-license", 50, "dual licen[cs]ed(?: under)?")],
    "freeware": [("freeware", 50, "(?:is|as) freeware")],
    "shareware": [("shareware", 50, "(?:is|as) shareware")],
    "share alike": [("share-alike", 40, "share alike")],
    "extent possible": [("cc0-1.0", 85, "to the extent possible under law(?: \\S+){1,12}? has waived all copyright and related or neighboring rights")],
    "associated a work": [("cc0-1.0", 90, "the person who associated a work with this deed has dedicated the work to the public domain")],
    "crown copyright": [("ogl", 60, "crown copyright")],
    "licence ouverte": [("etalab-2.0", 75, "licence ouverte(?: open licence)?(?: version 2 0)?(?: etalab)?")],
    "etalab": [("etalab-2.0", 75, "etalab licen[cs]e")],
    "datenlizenz": [("dl-de-by-2.0", 80, "datenlizenz deutschland namensnennung(?: version)? 2 0"), ("dl-de-zero-2.0", 80, "datenlizenz deutschland zero(?: version)? 2 0")],
    "rechte vorbehalten": [("reserved", 45, "alle rechte vorbehalten")],
    "droits": [("reserved", 45, "tous droits r\u00e9serv\u00e9s")],
    "derechos": [("reserved", 45, "todos los derechos reservados")],
    "rights reserved": [("reserved", 50, "(?:all|some|no) rights reserved")],
    "copyright": [("copyright", 20, r"copyright(?: c)?(?: (?:19|20)\d\d){1,40}")],
    "proprietary": [("proprietary", 60, "proprietary and confidential"), ("proprietary", 60, "(?:is|are) proprietary (?:software|material|information)")],
    "unauthori": [("proprietary", 70, "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: \\S+){0,6} (?:is )?(?:strictly )?prohibited")],
    "licensed under": [("license-reference", 10, "licensed under the terms of")],
}
#: Identifiers that the two rules for a "SPDX-License-Identifier" tag or "License:" field look up (fixed values).
SPDX = (
    "0BSD AAL Abstyles AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0-only AGPL-3.0-or-later Aladdin Apache-1.0 Apache-1.1 Apache-2.0 APL-1.0 APSL-1.0 APSL-2.0 "
    "Artistic-1.0 Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 "
    "CAL-1.0 CATOSL-1.1 CC-BY-1.0 CC-BY-2.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 "
    "CDDL-1.0 CDDL-1.1 CDLA-Permissive-1.0 CDLA-Permissive-2.0 CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 curl ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 "
    "FTL GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0-only GPL-2.0-or-later GPL-2.0 GPL-3.0-only GPL-3.0-or-later GPL-3.0 HPND ICU IJG IPL-1.0 ISC JSON "
    "LGPL-2.0 LGPL-2.1-only LGPL-2.1-or-later LGPL-2.1 LGPL-3.0-only LGPL-3.0-or-later LGPL-3.0 LiLiQ-P-1.1 LPL-1.02 LPPL-1.3c MIT MIT-0 MirOS MPL-1.0 MPL-1.1 MPL-2.0 "
    "MS-PL MS-RL MulanPSL-2.0 NASA-1.3 NCSA NPL-1.1 ODbL-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-1.0 OSL-2.1 OSL-3.0 PDDL-1.0 PHP-3.01 PostgreSQL "
    "PSF-2.0 Python-2.0 QPL-1.0 RPL-1.5 RPSL-1.0 Ruby Sleepycat SSPL-1.0 TCL Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C Watcom-1.0 WTFPL X11 Xnet Zend-2.0 Zlib ZPL-2.1"
).split()


#: What the normalised text says, by which identifier it means.
SPELLED = {" ".join(name.lower().replace("-", " ").replace(".", " ").split()): name.lower() for name in SPDX}


def rules() -> list[tuple[str, str, str | None, int]]:
    """(keyword, regex over the normalised text, label, priority); base phrases come first. A label of None is looked
    up in SPELLED, by the end of the match."""
    out: list[tuple[str, str, str | None, int]] = [(phrase.split()[0], phrase, label, 1000) for phrase, label in BASE.items()]
    for keyword, family in FAMILIES.items():
        out += [(keyword.strip(), regex.replace("{v} ", _V), label, priority) for label, priority, regex in family]
    any_ = "|".join(sorted(SPELLED, key=lambda x: (-len(x), x)))
    out += [("spdx", f"spdx license identifier (?:{any_})", None, 110), ("license", f"license (?:{any_})", None, 80)]
    return [(k, f" (?:{r})(?= )", label, p) for k, r, label, p in out]


#: Keywords within so many ordinary words that the prefilter asks for the first two words of the phrase instead.
_COMMON = ("all", "cc", "mit")


def _needed(keyword: str, regex: str) -> str:
    """Words that every match of a rule holds: "licen[cs]" if it is in each, else the keyword or the first two words."""
    sure = regex.removesuffix(")(?= )").removeprefix(" (?:")
    while (less := re.sub(r"\(\?:[^()]*\)(?:\?|\{0,\d+\})", "", sure)) != sure:
        sure = less
    plain = re.sub(r"\([^()]*\)", "", sure)
    if "|" not in plain and "licen" in plain:
        return "licen[cs]"
    return " ".join(sure.split()[:2]) if keyword in _COMMON else keyword


def prefilter() -> str:
    """Case-insensitive for ASCII, words apart by any gap, branches by their first letter: it finds a place in every
    text in which a rule matches."""
    words = sorted({_needed(k, r).replace(" ", GAP) for k, r, _, _ in rules()})
    letters = {w[0]: [x[1:] for x in words if x[0] == w[0]] for w in words}
    return "(?i)(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in letters.items()) + ")"


PREFILTER = prefilter()


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base, found) of every row.

    ``base`` holds all places of the BASE phrases, ``found`` the findings of all rules that stay after suppression;
    both are array<struct<label,priority,first,last>> with word positions from 0, ``last`` exclusive. Null and empty
    texts have no words and no findings. Repeated rows and null ids each give a row; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.when(text.rlike(PREFILTER), text).alias("hit"))
    spaced = F.translate(F.regexp_replace("hit", GAP, " "), upper, lower)
    base = base.select("doc_id", "n_words", F.concat(F.lit(" "), F.btrim(spaced, F.lit(" ")), F.lit(" ")).alias("norm"))
    families: dict[str, list[Column]] = {}
    for k, regex, label, p in rules():
        families.setdefault(k, []).append(F.struct(F.lit(regex).alias("regex"), F.lit(regex.replace(" (?:", " (", 1)).alias("marking"), F.lit(label).cast("string").alias("label"), F.lit(p).alias("priority")))
    table = F.array(*(F.struct(F.lit(k).alias("keyword"), F.array(*members).alias("rules")) for k, members in families.items()))
    spelled = F.create_map(*(F.lit(x) for pair in SPELLED.items() for x in pair))
    name_at = F.lit("^ (?:spdx license identifier|license) ")

    def n_words(match: Column) -> Column:
        return F.length(match) - F.length(F.replace(match, F.lit(" "), F.lit("")))

    def places(norm: Column, rule: Column) -> Column:
        """Matches of one rule as word spans. A mark before the first word of each tells where it stands, so every
        step is linear in the text."""

        def spans(found: Column) -> Column:
            words = F.split(F.regexp_replace(norm, rule["marking"], F.lit(f" {MARK}$1")), " ")  # the first is empty
            starts = F.filter(F.transform(words, lambda w, i: F.when(w.startswith(MARK), i - 1)), lambda i: i.isNotNull())
            label = lambda m: F.coalesce(rule["label"], F.try_element_at(spelled, F.regexp_replace(m, name_at, F.lit(""))))
            return F.zip_with(starts, found, lambda i, m: F.struct(label(m).alias("label"), rule["priority"].alias("priority"), i.alias("first"), (i + n_words(m)).alias("last")))

        found = F.regexp_extract_all(norm, rule["regex"], F.lit(0))
        return let(found, lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(F.array().cast(FOUND)))

    def matched(norm: Column) -> Column:
        gated = F.filter(table, lambda family: F.contains(norm, family["keyword"]))
        return F.flatten(F.transform(F.flatten(F.transform(gated, lambda family: family["rules"])), lambda r: places(norm, r)))

    none = F.array().cast(FOUND)
    all_ = base.select("doc_id", "n_words", F.when(F.col("norm").isNotNull(), let(F.col("norm"), matched)).otherwise(none).alias("all"))

    def inside(x: Column, y: Column) -> Column:
        """x lies in y, and y wins: longer with no lower priority among the rules, or the same span and higher."""
        within = (y["first"] <= x["first"]) & (x["last"] <= y["last"])
        same = (y["first"] == x["first"]) & (x["last"] == y["last"])
        rank = lambda s: F.struct(s["priority"], s["label"])
        return within & F.when(same, rank(y) > rank(x)).otherwise(y["priority"] >= x["priority"])

    from_rules = F.filter("all", lambda x: x["priority"] < 1000)
    kept = let(from_rules, lambda a: F.filter(a, lambda x: ~F.exists(a, lambda y: inside(x, y))))
    return all_.select("doc_id", "n_words", F.filter("all", lambda x: x["priority"] >= 1000).alias("base"), kept.alias("found"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License findings of all documents."""
    s = scan_licenses(read(spark, sf_dir, "documents"))
    labels = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.transform(c, lambda x: x["label"]) for c in cols)))), ",")
    first = F.transform("base", lambda x: x["first"])
    top = F.array_max(F.transform("found", lambda x: F.least(x["priority"], F.lit(100)) / 100.0))
    return s.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(first).cast("long").alias("first_word"), F.array_max(first).cast("long").alias("last_word"), labels("base").alias("base_labels"), labels("base", "found").alias("labels"), F.coalesce(top, F.when(F.size("base") > 0, 0.5).otherwise(0.0)).cast("double").alias("score"))
