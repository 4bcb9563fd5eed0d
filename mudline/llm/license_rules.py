"""Ordered signature rules for license scans: addresses, headers and bodies of licenses, and names in phrasings.

Rules are regular expressions over normalised text: lower-case words with one
space between.  Each match of a rule holds one of its keywords, so a rule runs
only where a keyword occurs; tests prove this for every rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from mudline.llm.license_names import DENIALS, NAMES, SHORT

#: Labels, words of which every variant holds one (between |), SPDX words, and the ways to name the license (fixed values).
LICENSES = [
    ("mit", "mit|expat", "mit", r"(?:mit|expat) licen[sc]e|mit x11 licen[sc]e"),
    ("apache-2", "apache|asl", "apache 2 0", r"apache (?:software )?licen[sc]e (?:version |v)?2(?: 0)?|apache (?:v)?2(?: 0)? licen[sc]e|asl 2 0"),
    ("apache-1.1", "apache", "apache 1 1", r"apache (?:software )?licen[sc]e (?:version |v)?1 1"),
    ("bsd-2-clause", "bsd", "bsd 2 clause", r"(?:simplified|freebsd|2 clause) bsd(?: licen[sc]e)?|bsd 2 clause(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", r"(?:new|modified|revised|3 clause) bsd(?: licen[sc]e)?|bsd 3 clause(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", r"(?:original|4 clause) bsd licen[sc]e|bsd 4 clause(?: licen[sc]e)?"),
    ("0bsd", "0bsd|zero", "0bsd", r"0bsd licen[sc]e|zero clause bsd licen[sc]e"),
    ("isc", "isc", "isc", r"isc licen[sc]e"),
    ("gpl-2", "general", "gpl 2 0", r"(?:gnu )?general public licen[sc]e (?:version |v)2(?: 0)?|gnu general public licen[sc]e 2 0"),
    ("gpl-3", "general", "gpl 3 0", r"(?:gnu )?general public licen[sc]e (?:version |v)3(?: 0)?|gnu general public licen[sc]e 3 0"),
    ("gpl-2", "gpl|gplv2", "gpl 2 0 only", r"(?:gnu )?gpl (?:version )?v?2(?: 0)?(?: licen[sc]e)?|gplv2"),
    ("gpl-3", "gpl|gplv3", "gpl 3 0 only", r"(?:gnu )?gpl (?:version )?v?3(?: 0)?(?: licen[sc]e)?|gplv3"),
    ("lgpl-2.1", "lesser", "lgpl 2 1", r"(?:gnu )?lesser general public licen[sc]e (?:version |v)?2 1"),
    ("lgpl-3", "lesser", "lgpl 3 0", r"(?:gnu )?lesser general public licen[sc]e (?:version |v)?3(?: 0)?"),
    ("lgpl-2", "library", "lgpl 2 0", r"gnu library general public licen[sc]e (?:version |v)?2(?: 0)?"),
    ("agpl-3", "affero", "agpl 3 0", r"(?:gnu )?affero general public licen[sc]e(?: (?:version |v)?3(?: 0)?)?"),
    ("mpl-1.1", "mozilla", "mpl 1 1", r"mozilla public licen[sc]e (?:version |v)?1 1"),
    ("mpl-2", "mozilla", "mpl 2 0", r"mozilla public licen[sc]e (?:version |v)?2(?: 0)?"),
    ("epl-1", "eclipse", "epl 1 0", r"eclipse public licen[sc]e (?:version |v)?1(?: 0)?"),
    ("epl-2", "eclipse", "epl 2 0", r"eclipse public licen[sc]e (?:version |v)?2(?: 0)?"),
    ("cddl-1", "cddl", "cddl 1 0", r"common development and distribution licen[sc]e cddl|cddl (?:version |v)?1(?: 0)?"),
    ("eupl-1.2", "european", "eupl 1 2", r"european union public licen[sc]e(?: (?:version |v)?1 2)?"),
    ("artistic-2", "artistic", "artistic 2 0", r"artistic licen[sc]e(?: (?:version |v)?2(?: 0)?)?"),
    ("zlib", "zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("boost-1", "boost", "bsl 1 0", r"boost software licen[sc]e(?: (?:version )?1 0)?"),
    ("unlicense", "unlicense", "unlicense", r"the unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", r"wtfpl(?: licen[sc]e)?"),
    ("python-2", "psf", "python 2 0", r"psf licen[sc]e(?: agreement)?"),
    ("postgresql", "postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("ofl-1.1", "sil", "ofl 1 1", r"sil open font licen[sc]e(?: (?:version )?1 1)?"),
    ("cc0", "cc0", "cc0 1 0", r"cc0(?: 1 0)?(?: universal)?|creative commons zero cc0"),
    ("cc-by-nc-sa", "nc", "cc by nc sa 4 0", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "nc", "cc by nc nd 4 0", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc", "nc", "cc by nc 4 0", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-sa", "sa", "cc by sa 4 0", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "nd", "cc by nd 4 0", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "noncommercial", "cc by nc sa 3 0", r"creative commons attribution noncommercial sharealike"),
    ("cc-by-nc", "noncommercial", "cc by nc 3 0", r"creative commons attribution noncommercial"),
    ("cc-by-sa", "sharealike", "cc by sa 3 0", r"creative commons attribution sharealike"),
    ("cc-by", "attribution", "cc by 4 0", r"creative commons attribution(?: [1-4] [05])?(?: international)? licen[sc]e"),
    ("odbl", "database", "odbl 1 0", r"open database licen[sc]e"),
    ("ms-pl", "microsoft", "ms pl", r"microsoft public licen[sc]e"),
    ("openssl", "openssl", "openssl", r"openssl licen[sc]e"),
    ("lgpl-2.1", "lgpl|lgplv2", "lgpl 2 1 or later", r"(?:gnu )?lgpl (?:version )?v?2 1(?: licen[sc]e)?|lgplv2 1"),
    ("lgpl-3", "lgpl|lgplv3", "lgpl 3 0 or later", r"(?:gnu )?lgpl (?:version )?v?3(?: 0)?(?: licen[sc]e)?|lgplv3"),
    ("agpl-3", "agpl|agplv3", "agpl 3 0 or later", r"(?:gnu )?agpl (?:version )?v?3(?: 0)?(?: licen[sc]e)?|agplv3"),
    ("mpl-2", "mpl|mplv2", "mpl 2 0 no copyleft exception", r"mpl (?:version )?v?2(?: 0)?(?: licen[sc]e)?|mplv2"),
    ("cc-by", "cc", "cc by 3 0", r"cc by [1-4] [05]"),
    ("proprietary", "proprietary", "licenseref proprietary", r"proprietary (?:software )?licen[sc]e agreement"),
]
#: Phrasings: name, strength from 0 to 1, expression with {name} or {spdx} (fixed values); stronger ones come first.
PHRASINGS = [
    ("spdx", 0.99, r"spdx licen[sc]e identifier {spdx}"),
    ("spdx_expression", 0.99, r"spdx licen[sc]e identifier (?:[a-z0-9]+ ){1,12}?(?:or|and|with) {spdx}"),
    ("grant", 0.95, r"(?:licensed|released|distributed|available|published|provided|redistributed|covered) (?:\w+ )?(?:under|by) (?:the )?(?:terms of )?(?:the |a )?(?:{name})"),
    ("terms", 0.9, r"(?:subject to|according to|in accordance with|governed by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{name})"),
    ("under", 0.85, r"under (?:the )?(?:terms of (?:the )?)?(?:{name})"),
    ("see", 0.7, r"(?:see|read|view) (?:the )?(?:full )?(?:{name})"),
    ("name", 0.6, r"(?:{name})"),
]
#: Headers and bodies of licenses, each written for one wording: label, keywords of which each match holds one (between |), expression (fixed values).
BODIES = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "noninfringement", r"merchantability fitness for a particular purpose and noninfringement in no event shall the authors"),
    ("x11", "consortium", r"except as contained in this notice the name of the x consortium shall not be used"),
    ("mit-0", "attribution", r"mit no attribution(?: licen[sc]e)?"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither", r"neither the names? of (?:\w+ ){1,12}nor the names of (?:its|their) contributors may be used"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display"),
    ("bsd-3-clause-clear", "patent", r"no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e"),
    ("isc", "copy", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("ntp", "suitability", r"makes no representations about the suitability of this software for any purpose"),
    ("apache-2", "apache", r"licensed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance"),
    ("apache-2", "contributor", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e"),
    ("apache-2", "unless", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("gpl-2", "general", r"gnu general public licen[sc]e as published by the free software foundation (?:either )?version 2"),
    ("gpl-3", "general", r"gnu general public licen[sc]e as published by the free software foundation (?:either )?version 3"),
    ("gpl", "general", r"you should have received a copy of the gnu general public licen[sc]e"),
    ("gpl", "copyleft", r"the gnu general public licen[sc]e is a free copyleft licen[sc]e for software"),
    ("gpl-2", "designed", r"the licen[sc]es for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", "conveying", r"conveying under any other circumstances is permitted solely under the conditions"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[sc]e as published by the free software foundation (?:either )?version 2 1"),
    ("lgpl-3", "lesser", r"gnu lesser general public licen[sc]e as published by the free software foundation (?:either )?version 3"),
    ("lgpl", "lesser", r"you should have received a copy of the gnu lesser general public licen[sc]e"),
    ("lgpl-2", "library", r"gnu library general public licen[sc]e as published by the free software foundation"),
    ("agpl-3", "affero", r"gnu affero general public licen[sc]e as published by the free software foundation (?:either )?version 3"),
    ("agpl-3", "remotely", r"all users interacting with it remotely through a computer network"),
    ("gfdl", "documentation", r"gnu free documentation licen[sc]e(?: version 1 [123])?"),
    ("gfdl", "invariant", r"with no invariant sections(?: with)? no front cover texts"),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? ?2 0"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("epl-1", "eclipse", r"made available under the terms of the eclipse public licen[sc]e v(?:ersion)? ?1 0"),
    ("epl-2", "eclipse", r"made available under the terms of the eclipse public licen[sc]e v(?:ersion)? ?2 0"),
    ("cddl-1", "development", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("cpl-1", "common", r"common public licen[sc]e (?:version |v)?1 0"),
    ("boost-1", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("boost-1", "boost", r"distributed under the boost software licen[sc]e version 1 0"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng", "libpng|png", r"the png reference library is supplied as is|libpng licen[sc]e version 2"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", r"do what the fuck you want to public licen[sc]e"),
    ("cc0", "waived", r"has waived all copyright and related or neighboring rights"),
    ("cc0", "dedication", r"cc0 1 0 universal (?:cc0 1 0 )?public domain dedication"),
    ("public-domain", "domain", r"(?:is|are) (?:hereby )?(?:placed|dedicated|released|put) (?:in|in to|into|to) the public domain"),
    ("public-domain", "domain", r"this (?:work|file|software|code|program|text|document) is in the public domain"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font licen[sc]e"),
    ("ofl-1.1", "reserved", r"with reserved font name"),
    ("artistic-1", "artistic", r"the artistic licen[sc]e preamble|same terms as perl itself artistic"),
    ("perl", "perl", r"under the same terms as perl(?: 5)?(?: itself)?"),
    ("python-2", "python", r"python software foundation licen[sc]e(?: version 2)?"),
    ("postgresql", "agreement", r"documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("odbl", "database", r"open data commons open database licen[sc]e"),
    ("odc-by", "commons", r"open data commons attribution licen[sc]e"),
    ("pddl", "commons", r"open data commons public domain dedication and licen[sc]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("bsl-1.1", "business", r"business source licen[sc]e (?:version )?1 1"),
    ("sspl-1", "server", r"server side public licen[sc]e"),
    ("elastic-2", "elastic", r"elastic licen[sc]e (?:version |v)?2(?: 0)?"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("beerware", "beer", r"the beer ware licen[sc]e|you can buy me a beer in return"),
    ("curl", "curl", r"curl licen[sc]e"),
    ("vim", "vim", r"vim licen[sc]e"),
    ("ruby", "ruby", r"ruby licen[sc]e|same terms as ruby"),
    ("php-3", "php", r"php licen[sc]e (?:version |v)?3 01?"),
    ("nasa-1.3", "nasa", r"nasa open source agreement"),
    ("ecl-2", "educational", r"educational community licen[sc]e(?: version 2 0)?"),
    ("eupl-1.2", "eupl", r"eupl (?:version |v)?1 2|licensed under the eupl"),
    ("cecill-2.1", "cecill", r"cecill(?: (?:version |v)?2 [01])?(?: free software licen[sc]e)?"),
    ("mulan-psl-2", "mulan", r"mulan psl v2|mulan permissive software licen[sc]e"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?"),
    ("llama-community", "llama", r"llama [234](?: [0-9])? community licen[sc]e"),
    ("all-rights-reserved", "reserved", r"all rights reserved"),
    ("no-redistribution", "redistribution", r"(?:no|not for) redistribution|redistribution is (?:strictly )?prohibited"),
    ("no-reproduction", "reproduced", r"no part of this (?:publication|book|work|document) may be reproduced"),
    ("personal-use", "personal", r"for personal (?:and )?non commercial use only|for personal use only"),
    ("non-commercial", "commercial", r"for non commercial (?:use|purposes|research)(?: only)?"),
    ("research-only", "research|academic", r"for (?:academic|research) (?:use|purposes) only"),
    ("confidential", "confidential", r"(?:confidential and proprietary|proprietary and confidential)"),
]
#: Addresses of licenses as words: label, keywords, expression (fixed values).
ADDRESSES = [
    ("apache-2", "apache", r"apache org licen[sc]es licen[sc]e 2 0"),
    ("apache-1.1", "apache", r"apache org licen[sc]es licen[sc]e 1 1"),
    ("mit", "opensource", r"opensource org licen[sc]es mit(?: licen[sc]e)?"),
    ("bsd-2-clause", "opensource", r"opensource org licen[sc]es bsd 2 clause"),
    ("bsd-3-clause", "opensource", r"opensource org licen[sc]es bsd 3 clause"),
    ("isc", "opensource", r"opensource org licen[sc]es isc"),
    ("gpl-2", "gnu", r"gnu org licen[sc]es (?:old licen[sc]es )?gpl 2 0"),
    ("gpl-3", "gnu", r"gnu org licen[sc]es gpl 3 0"),
    ("gpl", "gnu", r"gnu org licen[sc]es gpl"),
    ("lgpl-2.1", "gnu", r"gnu org licen[sc]es (?:old licen[sc]es )?lgpl 2 1"),
    ("lgpl-3", "gnu", r"gnu org licen[sc]es lgpl 3 0"),
    ("agpl-3", "gnu", r"gnu org licen[sc]es agpl(?: 3 0)?"),
    ("gfdl", "gnu", r"gnu org licen[sc]es fdl(?: 1 3)?"),
    ("mpl-2", "mozilla", r"mozilla org (?:en us )?mpl 2 0"),
    ("mpl-1.1", "mozilla", r"mozilla org mpl 1 1|mozilla org mpl mpl 1 1"),
    ("epl-1", "eclipse", r"eclipse org legal epl v10"),
    ("epl-2", "eclipse", r"eclipse org legal epl (?:2 0|v20)"),
    ("boost-1", "boost", r"boost org licen[sc]e 1 0"),
    ("unlicense", "unlicense", r"unlicense org"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licen[sc]es by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licen[sc]es by nc nd [1-4] [05]"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licen[sc]es by nc [1-4] [05]"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licen[sc]es by sa [1-4] [05]"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licen[sc]es by nd [1-4] [05]"),
    ("cc-by", "creativecommons", r"creativecommons org licen[sc]es by [1-4] [05]"),
    ("odbl", "opendatacommons", r"opendatacommons org licen[sc]es odbl"),
    ("ofl-1.1", "sil", r"scripts sil org ofl"),
    ("wtfpl", "wtfpl", r"wtfpl net"),
]
#: The base phrases of the contract and their labels (fixed values).
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]


@dataclass(frozen=True)
class Rule:
    label: str
    phrasing: str
    strength: float
    keywords: tuple[str, ...]
    pattern: re.Pattern


def build_rules() -> list[Rule]:
    """All rules in order of priority: by phrasing, then by license."""
    made = lambda label, kind, strength, words, shape: Rule(label, kind, strength, words, re.compile(f"(?<= )(?:{shape})(?= )"))
    table = lambda kind, strength, rows: [made(label, kind, strength, tuple(word.split("|")), shape) for label, word, shape in rows]
    out = table("address", 0.98, ADDRESSES) + table("body", 0.97, BODIES)
    for phrasing, strength, shape in PHRASINGS:
        if phrasing == "see":
            out += table("short", 0.8, SHORT)
        for label, word, spdx, name in LICENSES:
            keywords = ("spdx",) if phrasing.startswith("spdx") else tuple(word.split("|"))
            out.append(made(label, phrasing, strength, keywords, shape.replace("{name}", name).replace("{spdx}", spdx)))
    # versions before families: the shorter match of a family lies in the longer one
    return out + table("full_name", 0.6, NAMES)


def denials() -> re.Pattern:
    """Where a text denies a license; what lies inside says nothing of one."""
    return re.compile(f"(?<= )(?:{'|'.join(DENIALS)})(?= )")
