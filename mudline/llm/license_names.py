"""License names in their short and full forms, families without a version, and sentences that deny a license: written by hand, one expression a wording.

As in ``license_rules``: label, keywords of which each match holds one (between
|), expression over lower-case words.  All fixed values.
"""

from __future__ import annotations

#: Short ways to say that something has a license; stronger than bare names.
SHORT = [
    ("mit", "mit", r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?mit"),
    ("mit", "mit", r"(?:is|are) mit licensed"), ("mit", "mit", r"mit licensed (?:software|code|project|library)"), ("mit", "mit", r"licen[sc]e mit"), ("mit", "mit", r"mit style licen[sc]e"), ("mit", "massachusetts", r"massachusetts institute of technology licen[sc]e"),
    ("mit", "mit", r"dual licensed (?:under )?(?:the )?mit"), ("mit", "mit", r"(?:either|both) (?:of )?(?:the )?mit (?:licen[sc]e )?(?:or|and)"), ("mit", "mit", r"mit (?:and|or) (?:the )?apache"),
    ("apache-2", "apache", r"(?:dual licensed|licensed) (?:under )?mit (?:or |and )?apache(?: licen[sc]e)? 2 0"), ("apache-2", "apache", r"mit (?:licen[sc]e )?(?:and|or) (?:the )?apache(?: licen[sc]e)?(?: version)? 2(?: 0)?"),
    ("apache-2", "apache", r"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: licen[sc]e)?(?: version)? v?2(?: 0)?"), ("apache-2", "apache", r"apache 2 0"), ("apache-2", "apache", r"apache 2 licensed"), ("apache-2", "apache", r"licen[sc]e apache(?: licen[sc]e)? 2(?: 0)?"), ("apache-2", "al2|alv2", r"alv?2 licen[sc]e"),
    ("apache", "apache", r"(?:licensed|released|distributed|available|published) under (?:the )?apache(?: software)? licen[sc]e"), ("apache", "apache", r"apache licensed"),
    ("bsd", "bsd", r"(?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of (?:the )?)?bsd(?: style)?(?: licen[sc]e)?"), ("bsd", "bsd", r"(?:is|are) bsd licensed"), ("bsd", "bsd", r"bsd style licen[sc]e"), ("bsd", "bsd", r"bsd like licen[sc]e"), ("bsd", "berkeley", r"berkeley software distribution licen[sc]e"), ("bsd", "bsd", r"licen[sc]e bsd"),
    ("gpl", "gpl", r"(?:licensed|released|distributed|available|published|covered) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl"), ("gpl", "gpl", r"under the gnu gpl"), ("gpl", "gpl", r"(?:is|are) gpl licensed|gpl ed software"), ("gpl", "gpl", r"licen[sc]e gpl"),
    ("gpl-2", "gpl", r"(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl v?2(?: 0)?(?: only| or later)?"), ("gpl-2", "gplv2", r"under gplv2(?: only| or later)?"), ("gpl-2", "gpl2", r"licen[sc]e gpl2"), ("gpl-3", "gplv3", r"under gplv3(?: only| or later)?"), ("gpl-3", "gpl3", r"licen[sc]e gpl3"), ("gpl-3", "gpl", r"(?:licensed|released|distributed|available) under (?:the )?(?:gnu )?gpl v?3(?: 0)?(?: only| or later)?"),
    ("lgpl", "lgpl", r"(?:licensed|released|distributed|available|covered) under (?:the )?(?:gnu )?lgpl"), ("lgpl", "lgpl", r"licen[sc]e lgpl"), ("lgpl-2.1", "lgpl2|lgplv2|lgpl", r"licen[sc]e lgpl ?v?2 1"), ("agpl", "agpl", r"(?:licensed|released|distributed|available|covered) under (?:the )?(?:gnu )?agpl"), ("agpl-3", "agplv3", r"under (?:the )?agplv3"), ("agpl", "agpl", r"licen[sc]e agpl"),
    ("mpl", "mpl", r"(?:licensed|released|distributed|available) under (?:the )?mpl"), ("mpl-2", "mpl", r"mpl 2 0"), ("mpl-1.1", "mpl", r"mpl 1 1"), ("epl", "epl", r"(?:licensed|released|distributed|available) under (?:the )?epl"), ("isc", "isc", r"(?:licensed|released|distributed|available) under (?:the )?isc"), ("zlib", "zlib", r"(?:licensed|released|distributed|available) under (?:the )?zlib"),
    ("unlicense", "unlicense", r"(?:licensed|released|distributed|available) under (?:the )?unlicense"), ("wtfpl", "wtfpl", r"(?:licensed|released|distributed|available) under (?:the )?wtfpl"), ("cc0", "cc0", r"(?:licensed|released|distributed|available) under (?:the )?cc0"), ("cc0", "cc", r"cc zero(?: 1 0)?"),
    ("public-domain", "domain", r"released to the public domain"), ("public-domain", "domain", r"public domain software"), ("public-domain", "domain", r"no copyright is claimed (?:\w+ ){0,6}public domain"), ("boost-1", "bsl", r"bsl 1 0"), ("boost-1", "boost", r"(?:licensed|released|distributed|available) under (?:the )?boost"),
    ("cc-by", "cc", r"(?:licensed|released|distributed|available|published) under (?:a |the )?cc by(?: licen[sc]e)?"), ("cc-by", "attribution", r"creative commons attribution(?: licen[sc]e)?(?: version)? [1-4] [05](?: (?:international|unported|generic))?"), ("cc-by-sa", "sharealike|share", r"creative commons attribution share ?alike [1-4] [05](?: (?:international|unported|generic))?"),
    ("cc-by-nd", "noderivatives|noderivs|derivatives|derivs", r"creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?"), ("cc-by-nc", "noncommercial|commercial", r"creative commons attribution non ?commercial [1-4] [05]"), ("cc-by-nc-nd", "noderivatives|noderivs|derivatives|derivs", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?"), ("cc-by-nc-sa", "sharealike|share", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("classpath-exception", "classpath", r"(?:with )?(?:the )?classpath exception(?: 2 0)?"), ("llvm-exception", "llvm", r"(?:with )?llvm exceptions?"), ("gcc-exception", "gcc", r"gcc (?:runtime library )?exception(?: 3 [01]| 2 0)?"), ("linking-exception", "linking|link", r"(?:openssl )?linking exception|special exception (?:\w+ ){0,8}link"), ("bison-exception", "bison", r"bison exception(?: 2 2)?"), ("font-exception", "font", r"font exception(?: 2 0)?"), ("autoconf-exception", "autoconf", r"autoconf exception(?: [23] 0)?"), ("syscall-note", "syscall", r"linux syscall note"),
    ("proprietary", "proprietary", r"(?:this is )?proprietary software"), ("proprietary", "unauthorized", r"unauthorized copying (?:of this file )?(?:\w+ ){0,5}(?:is )?(?:strictly )?prohibited"), ("proprietary", "commercial", r"(?:requires|under) (?:a )?commercial licen[sc]e"), ("proprietary", "evaluation|trial", r"(?:evaluation|trial) licen[sc]e agreement"), ("proprietary", "end", r"end user licen[sc]e agreement"),
]
#: Full names; bodies and phrasings that hold them come first.
NAMES = [
    ("afl-3", "academic", r"academic free licen[sc]e(?: (?:version |v)?3 0)?"), ("afl-2", "academic", r"academic free licen[sc]e (?:version |v)?2 [01]"), ("aal", "attribution", r"attribution assurance licen[sc]e"), ("adobe-glyph", "adobe", r"adobe glyph list licen[sc]e"), ("aladdin", "aladdin", r"aladdin free public licen[sc]e"), ("apsl-2", "apple", r"apple public source licen[sc]e(?: (?:version |v)?2 0)?"), ("apsl-1", "apple", r"apple public source licen[sc]e (?:version |v)?1 [012]"),
    ("artistic-1", "artistic", r"artistic licen[sc]e (?:version |v)?1(?: 0)?"), ("clarified-artistic", "clarified", r"clarified artistic licen[sc]e"), ("bittorrent", "bittorrent", r"bittorrent open source licen[sc]e"), ("blue-oak", "blue", r"blue oak model licen[sc]e(?: 1 0 0)?"), ("bsl-1.1", "busl", r"busl(?: 1 1)?"), ("catosl", "computer", r"computer associates trusted open source licen[sc]e"), ("cddl-1.1", "cddl", r"cddl (?:version |v)?1 1"), ("cddl", "common", r"common development and distribution licen[sc]e"),
    ("cecill-b", "cecill", r"cecill b(?: licen[sc]e)?"), ("cecill-c", "cecill", r"cecill c(?: licen[sc]e)?"), ("cpal-1", "cpal|attribution", r"cpal(?: 1 0)?|common public attribution licen[sc]e"), ("cpl", "common", r"common public licen[sc]e"), ("cpol", "code", r"code project open licen[sc]e"), ("cua-opl", "cua", r"cua office public licen[sc]e"), ("d-fsl", "deutsche", r"deutsche freie software lizenz"), ("ecl-1", "educational", r"educational community licen[sc]e (?:version )?1 0"),
    ("efl-2", "eiffel", r"eiffel forum licen[sc]e(?: (?:version |v)?2)?"), ("entessa", "entessa", r"entessa public licen[sc]e"), ("epl", "eclipse", r"eclipse public licen[sc]e"), ("edl-1", "eclipse", r"eclipse distribution licen[sc]e(?: (?:version |v)?1 0)?"), ("eudatagrid", "datagrid", r"eu datagrid software licen[sc]e"), ("eupl-1.1", "eupl", r"eupl (?:version |v)?1 1"), ("fair", "fair", r"the fair licen[sc]e|fair licen[sc]e fair"), ("frameworx", "frameworx", r"frameworx open licen[sc]e"), ("freetype", "freetype", r"(?:the )?freetype (?:project )?licen[sc]e|ftl licen[sc]e freetype"),
    ("fsfap", "fsf", r"fsf all permissive licen[sc]e"), ("gl2ps", "gl2ps", r"gl2ps licen[sc]e"), ("glide", "3dfx", r"3dfx glide source code general public licen[sc]e"), ("hpnd", "historical", r"historical permission notice and disclaimer"), ("ibm-pl", "ibm", r"ibm public licen[sc]e(?: (?:version |v)?1 0)?"), ("icu", "icu", r"icu licen[sc]e"), ("ijg", "jpeg", r"independent jpeg group(?: s)? (?:software|licen[sc]e)"), ("imagemagick", "imagemagick", r"imagemagick licen[sc]e"), ("intel", "intel", r"intel (?:open source|simplified software) licen[sc]e"), ("ipa-font", "ipa", r"ipa font licen[sc]e"),
    ("jasper-2", "jasper", r"jasper licen[sc]e(?: version 2 0)?"), ("json", "json", r"(?:the )?json licen[sc]e"), ("latex", "lppl|latex", r"lppl(?: (?:version |v)?1 [0-3]c?)?|latex project public licen[sc]e(?: (?:version |v)?1 [0-3]c?)?"), ("free-art", "art", r"free art licen[sc]e(?: 1 [23])?|licence art libre"), ("leptonica", "leptonica", r"leptonica licen[sc]e"), ("liliq", "liliq", r"liliq (?:p|r|rplus)(?: 1 1)?"), ("lucent-1", "lucent", r"lucent public licen[sc]e(?: (?:version |v)?1 0[02]?)?"),
    ("miros", "miros", r"(?:the )?miros licen[sc]e"), ("motosoto", "motosoto", r"motosoto open source licen[sc]e"), ("mpl", "mozilla", r"mozilla public licen[sc]e"), ("ms-lpl", "limited", r"microsoft limited public licen[sc]e"), ("multics", "multics", r"multics licen[sc]e"), ("naumen", "naumen", r"naumen public licen[sc]e"), ("ncsa", "ncsa|illinois", r"ncsa open source licen[sc]e|university of illinois (?:ncsa )?open source licen[sc]e|uiuc licen[sc]e illinois"), ("netcdf", "netcdf", r"netcdf licen[sc]e"), ("net-snmp", "snmp", r"net snmp licen[sc]e"), ("ngpl", "nethack", r"nethack general public licen[sc]e"),
    ("nokia", "nokia", r"nokia open source licen[sc]e"), ("npl", "netscape", r"netscape public licen[sc]e(?: (?:version |v)?1 [01])?"), ("nposl-3", "profit", r"non profit open software licen[sc]e(?: 3 0)?"), ("ntp", "ntp", r"ntp licen[sc]e"), ("oclc-2", "oclc", r"oclc research public licen[sc]e(?: 2 0)?"), ("ogl-uk", "government", r"open government licen[sc]e(?: (?:version |v)?[123] 0)?"), ("ogc", "ogc", r"ogc software licen[sc]e"), ("openldap", "openldap|oldap", r"openldap public licen[sc]e(?: (?:version )?2 [0-9])?|oldap 2 [0-9]"), ("open-publication", "publication", r"open publication licen[sc]e(?: (?:version |v)?1 0)?"),
    ("oset", "oset", r"oset (?:foundation )?public licen[sc]e"), ("osl-3", "open", r"open software licen[sc]e(?: (?:version |v)?3 0)?"), ("osl-2", "open", r"open software licen[sc]e (?:version |v)?2 [01]"), ("osl-1", "open", r"open software licen[sc]e (?:version |v)?1 [01]"), ("parity", "parity", r"parity public licen[sc]e(?: [67] 0 0)?"), ("php", "php", r"php licen[sc]e"), ("polyform-nc", "polyform", r"polyform noncommercial licen[sc]e(?: 1 0 0)?"), ("polyform-sb", "polyform", r"polyform small business licen[sc]e(?: 1 0 0)?"), ("polyform", "polyform", r"polyform (?:strict|shield|free trial|perimeter|internal use) licen[sc]e(?: 1 0 0)?"), ("prosperity", "prosperity", r"prosperity public licen[sc]e(?: 3 0 0)?"),
    ("qpl-1", "q|qpl", r"q public licen[sc]e(?: (?:version )?1 0)?|qpl 1 0"), ("qhull", "qhull", r"qhull licen[sc]e"), ("rpl", "reciprocal", r"reciprocal public licen[sc]e(?: 1 [15])?"), ("rpsl-1", "realnetworks", r"realnetworks public source licen[sc]e(?: (?:version |v)?1 0)?"), ("rscpl", "ricoh", r"ricoh source code public licen[sc]e"), ("ruby", "ruby", r"the ruby licen[sc]e"), ("sax-pd", "sax", r"sax public domain notice"), ("saxpath", "saxpath", r"saxpath licen[sc]e"), ("sgi-b-2", "sgi", r"sgi free software licen[sc]e b(?: (?:version |v)?2 0)?"), ("simpl-2", "simple", r"simple public licen[sc]e(?: (?:version )?2 0)?"),
    ("sissl", "sun", r"sun industry standards source licen[sc]e(?: (?:version |v)?1 [12])?"), ("sleepycat", "sleepycat", r"sleepycat licen[sc]e"), ("sml-nj", "standard", r"standard ml of new jersey licen[sc]e"), ("spl-1", "sun", r"sun public licen[sc]e(?: (?:version |v)?1 0)?"), ("spencer", "spencer", r"spencer licen[sc]e (?:86|94|99)"), ("sugarcrm", "sugarcrm", r"sugarcrm public licen[sc]e(?: (?:version |v)?1 1 3)?"), ("tcl", "tcl", r"tcl tk licen[sc]e|tcl licen[sc]e"), ("tcp-wrappers", "tcp", r"tcp wrappers licen[sc]e"), ("torque", "torque", r"torque (?:v2 5 )?software licen[sc]e(?: (?:version |v)?1 1)?"), ("tapr-ohl", "tapr", r"tapr open hardware licen[sc]e(?: 1 0)?"),
    ("cern-ohl", "cern", r"cern open hardware licen[sc]e(?: (?:version |v)?[12](?: [012])?)?|cern ohl(?: (?:p|s|w))?(?: 2 0)?"), ("solderpad", "solderpad", r"solderpad hardware licen[sc]e(?: (?:version |v)?(?:2 [01]|0 51))?"), ("upl-1", "universal", r"universal permissive licen[sc]e(?: (?:version |v)?1 0)?"), ("unicode", "unicode", r"unicode (?:licen[sc]e(?: v3)?|terms of use)(?: data files and software)?"), ("vsl-1", "vovida", r"vovida software licen[sc]e(?: (?:version |v)?1 0)?"), ("w3c", "w3c", r"w3c software (?:and document )?(?:notice and )?licen[sc]e"), ("watcom", "watcom", r"sybase open watcom public licen[sc]e(?: 1 0)?"), ("wxwindows", "wxwindows", r"wxwindows library licen[sc]e(?: 3 1)?"),
    ("x11", "x11", r"x11 licen[sc]e"), ("xfree86", "xfree86", r"xfree86 licen[sc]e(?: 1 1)?"), ("xinetd", "xinetd", r"xinetd licen[sc]e"), ("xnet", "x", r"x net licen[sc]e"), ("yahoo-1.1", "yahoo", r"yahoo public licen[sc]e(?: (?:version |v)?1 [01])?"), ("zend-2", "zend", r"zend licen[sc]e(?: (?:version |v)?2 0)?"), ("zimbra", "zimbra", r"zimbra public licen[sc]e(?: (?:version |v)?1 [34])?"), ("zpl-2", "zope", r"zope public licen[sc]e(?: (?:version |v)?2 [01])?"), ("zpl-1", "zope", r"zope public licen[sc]e (?:version |v)?1 1"), ("bsd-source", "bsd", r"bsd source code attribution"),
    ("bsd-protection", "bsd", r"bsd protection licen[sc]e"), ("bsd-patent", "bsd", r"bsd (?:2 clause )?plus patent(?: licen[sc]e)?"), ("bsd", "bsd", r"bsd licen[sc]es?"), ("mit-cmu", "cmu", r"cmu licen[sc]e|mit cmu licen[sc]e"), ("mit-advertising", "enlightenment", r"enlightenment licen[sc]e"), ("gpl", "general", r"(?:gnu )?general public licen[sc]e"), ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e"), ("lgpl", "library", r"(?:gnu )?library general public licen[sc]e"), ("gfdl", "documentation", r"free documentation licen[sc]e(?: (?:version |v)?1 [123])?"), ("gpl-1", "general", r"general public licen[sc]e (?:version |v)?1(?: 0)?"),
    ("eupl", "eupl", r"eupl licen[sc]e"), ("mulan-psl-1", "mulan", r"mulan psl v1"), ("mulan-publ", "mulan", r"mulan public licen[sc]e"), ("opensoftware-cpl", "copyfree", r"copyfree (?:open innovation )?licen[sc]e"), ("hippocratic", "hippocratic", r"hippocratic licen[sc]e(?: 2 1| 3 0)?"), ("anti-996", "996", r"anti 996 licen[sc]e"), ("commons-clause", "commons", r"commons clause(?: licen[sc]e condition)?"), ("confluent", "confluent", r"confluent community licen[sc]e"), ("timescale", "timescale", r"timescale licen[sc]e"), ("cockroach", "cockroachdb", r"cockroachdb community licen[sc]e"),
    ("gemma", "gemma", r"gemma (?:terms of use|licen[sc]e)"), ("bloom-rail", "rail", r"(?:bloom |bigcode )?rail licen[sc]e(?: 1 0)?"), ("falcon", "falcon", r"falcon (?:180b )?(?:tii )?licen[sc]e"), ("cdla-permissive", "cdla", r"cdla permissive(?: (?:1|2) 0)?|community data licen[sc]e agreement cdla permissive"), ("cdla-sharing", "cdla", r"cdla sharing(?: 1 0)?"), ("odc-by", "odc", r"odc by(?: 1 0)?"), ("etalab-2", "etalab", r"(?:licence ouverte )?etalab(?: 2 0)?"), ("dl-de-by-2", "datenlizenz", r"datenlizenz deutschland (?:namensnennung|zero)(?: (?:version )?2 0)?"), ("ogl-canada", "canada", r"open government licen[sc]e canada"), ("nist", "nist", r"nist (?:software )?(?:licen[sc]e|public domain notice)"),
]
#: Sentences that deny a license: what they span says nothing of one.
DENIALS = [
    r"(?:not|never|no longer|neither|isn t|aren t) (?:\w+ ){0,3}?(?:licensed|released|distributed|available|published|provided|covered) (?:under|by) (?:\w+ ){1,8}?(?:licen[sc]es?|gpl|lgpl|mit|bsd|apache|mpl)(?: licen[sc]es?)?(?: (?:version )?v?[0-9](?: [0-9])?)?",
    r"(?:not|never|no longer) (?:subject to|governed by|under) (?:\w+ ){1,8}?(?:licen[sc]es?|gpl|lgpl|mit|bsd|apache|mpl)(?: licen[sc]es?)?(?: (?:version )?v?[0-9](?: [0-9])?)?",
    r"(?:incompatible|not compatible) with (?:\w+ ){1,6}?(?:licen[sc]es?|gpl|lgpl|mit|bsd|apache|mpl)(?: licen[sc]es?)?(?: (?:version )?v?[0-9](?: [0-9])?)?",
    r"(?:unlike|instead of|rather than) (?:\w+ ){1,5}?(?:licen[sc]es?|gpl|lgpl|mit|bsd|apache|mpl)(?: licen[sc]es?)?(?: (?:version )?v?[0-9](?: [0-9])?)?",
]
