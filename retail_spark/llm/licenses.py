"""License scans: ordered signature rules behind keyword gates, overlaps settled by priority and containment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_spark.llm.native import find_all, indexes, let, prefixes, whole_text, with_one

# Fixed values of the contract: what stands between words (A-Z count as letters, whatever their case), and the base phrases.
_SEPARATORS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
BETWEEN = f"[{_SEPARATORS}]+"
WORD = f"[^{_SEPARATORS}]+"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Priorities: an identifier or address names one license; a notice grants it; a mention may be talk.
IDENTIFIER, NOTICE, MENTION = 3, 2, 1
#: Above all: what it covers is no license of the text. Such detections silence others and are not reported.
SILENCE = 4
CONFIDENCE = {IDENTIFIER: 1.0, NOTICE: 0.9, MENTION: 0.6}
BASE_CONFIDENCE = 0.5


@dataclass(frozen=True)
class Rule:
    """A signature: ``pattern`` runs over words with one space between; ``root`` and ``key`` are part of all it matches."""

    label: str
    root: str
    key: str
    pattern: str
    priority: int


# Licenses: label, keyword, name as its owners write it, SPDX identifier in words, address in words.
LICENSES = (
    ("apache-2.0", "apache", "apache (?:software )?license (?:v|v2|version )?2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("apache-1.1", "apache", "apache (?:software )?license (?:version )?1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-1.0", "apache", "apache (?:software )?license (?:version )?1 0", "apache 1 0", "apache org licenses license 1 0"),
    ("mit", "mit", "mit (?:x11 )?license", "mit", "opensource org licenses mit"),
    ("mit-0", "mit", "mit no attribution license", "mit 0", "opensource org licenses mit 0"),
    ("x11", "x11", "x11 license", "x11", "xfree86 org licenses x11"),
    ("isc", "isc", "isc license", "isc", "opensource org licenses isc"),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause) license", "0bsd", "opensource org licenses 0bsd"),
    ("bsd-1-clause", "bsd", "(?:1 clause bsd|bsd 1 clause) license", "bsd 1 clause", "opensource org licenses bsd 1 clause"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|freebsd|2 clause bsd|bsd 2 clause) license", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|3 clause bsd|bsd 3 clause) license", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original bsd|old bsd|4 clause bsd|bsd 4 clause) license", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("gpl-1.0", "general", "(?:gnu )?general public license (?:v|version )?1(?: 0)?", "gpl 1 0(?: only| or later)?", "gnu org licenses gpl 1 0"),
    ("gpl-2.0", "general", "(?:gnu )?general public license (?:v|version )?2(?: 0)?", "gpl 2 0(?: only| or later)?", "gnu org licenses gpl 2 0"),
    ("gpl-3.0", "general", "(?:gnu )?general public license (?:v|version )?3(?: 0)?", "gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0"),
    ("lgpl-2.0", "library", "(?:gnu )?library general public license(?: version)?(?: 2(?: 0)?)?", "lgpl 2 0(?: only| or later)?", "gnu org licenses lgpl 2 0"),
    ("lgpl-2.1", "lesser", "(?:gnu )?lesser general public license (?:v|version )?2 1", "lgpl 2 1(?: only| or later)?", "gnu org licenses lgpl 2 1"),
    ("lgpl-3.0", "lesser", "(?:gnu )?lesser general public license (?:v|version )?3(?: 0)?", "lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public license(?: (?:v|version )?3(?: 0)?)?", "agpl 3 0(?: only| or later)?", "gnu org licenses agpl 3 0"),
    ("gfdl-1.2", "documentation", "(?:gnu )?free documentation license (?:version )?1 2", "gfdl 1 2(?: only| or later)?", "gnu org licenses fdl 1 2"),
    ("gfdl-1.3", "documentation", "(?:gnu )?free documentation license (?:version )?1 3", "gfdl 1 3(?: only| or later)?", "gnu org licenses fdl 1 3"),
    ("mpl-1.0", "mozilla", "mozilla public license (?:version )?1 0", "mpl 1 0", "mozilla org mpl 1 0"),
    ("mpl-1.1", "mozilla", "mozilla public license (?:version )?1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public license (?:v |version )?2 0", "mpl 2 0", "mozilla org mpl 2 0"),
    ("epl-1.0", "eclipse", "eclipse public license (?:v|version )?1 0", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", "eclipse public license (?:v|version )?2 0", "epl 2 0", "eclipse org legal epl v20"),
    ("cpl-1.0", "common", "common public license (?:version )?1 0", "cpl 1 0", "opensource org licenses cpl 1 0"),
    ("cddl-1.0", "distribution", "common development and distribution license(?: version)? 1 0", "cddl 1 0", "opensource org licenses cddl 1 0"),
    ("cddl-1.1", "distribution", "common development and distribution license(?: version)? 1 1", "cddl 1 1", "spdx org licenses cddl 1 1"),
    ("eupl-1.1", "european", "european union public licen[cs]e (?:v|version )?1 1", "eupl 1 1", "joinup ec europa eu eupl 1 1"),
    ("eupl-1.2", "european", "european union public licen[cs]e (?:v|version )?1 2", "eupl 1 2", "joinup ec europa eu eupl 1 2"),
    ("artistic-1.0", "artistic", "artistic license (?:version )?1 0", "artistic 1 0", "opensource org licenses artistic 1 0"),
    ("artistic-2.0", "artistic", "artistic license (?:version )?2 0", "artistic 2 0", "opensource org licenses artistic 2 0"),
    ("zlib", "zlib", "zlib(?: libpng)? license", "zlib", "opensource org licenses zlib"),
    ("unlicense", "unlicense", "(?:the )?unlicense(?: license)?", "unlicense", "unlicense org"),
    ("wtfpl", "what", "do what the fuck you want to public license", "wtfpl", "wtfpl net"),
    ("bsl-1.0", "boost", "boost software license(?: (?:version )?1 0)?", "bsl 1 0", "boost org license 1 0"),
    ("busl-1.1", "business", "business source license(?: 1 1)?", "busl 1 1", "mariadb com bsl11"),
    ("sspl-1.0", "server", "server side public license(?: (?:version |v)?1(?: 0)?)?", "sspl 1 0", "mongodb com licensing server side public license"),
    ("elastic-2.0", "elastic", "elastic license(?: (?:version )?2 0)?", "elastic 2 0", "elastic co licensing elastic license"),
    ("psf-2.0", "python", "python software foundation license(?: version 2)?", "psf 2 0", "docs python org 3 license"),
    ("php-3.01", "php", "php license(?: version)? 3 01", "php 3 01", "php net license 3 01"),
    ("ruby", "ruby", "ruby license", "ruby", "ruby lang org en about license"),
    ("openssl", "openssl", "openssl license", "openssl", "openssl org source license"),
    ("postgresql", "postgresql", "postgresql license", "postgresql", "postgresql org about licence"),
    ("ncsa", "illinois", "university of illinois (?:ncsa )?open source license", "ncsa", "otm illinois edu uiuc openSource license"),
    ("ofl-1.1", "font", "(?:sil )?open font license(?: (?:version )?1 1)?", "ofl 1 1", "scripts sil org ofl license"),
    ("cc0-1.0", "cc0", "cc0 (?:1 0 )?(?:universal )?(?:public domain )?(?:license|dedication)", "cc0 1 0", "creativecommons org publicdomain zero 1 0 license"),
    ("cc-by-3.0", "creative", "creative commons attribution 3 0(?: unported)?(?: international)? license", "cc by 3 0", "creativecommons org licenses by 3 0"),
    ("cc-by-4.0", "creative", "creative commons attribution 4 0(?: international)?(?: public)? license", "cc by 4 0", "creativecommons org licenses by 4 0"),
    ("cc-by-sa-3.0", "creative", "creative commons attribution share ?alike 3 0(?: unported)? license", "cc by sa 3 0", "creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4.0", "creative", "creative commons attribution share ?alike 4 0(?: international)? license", "cc by sa 4 0", "creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", "creative", "creative commons attribution non ?commercial 4 0(?: international)? license", "cc by nc 4 0", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", "creative", "creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)? license", "cc by nd 4 0", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", "creative", "creative commons attribution non ?commercial share ?alike 4 0(?: international)? license", "cc by nc sa 4 0", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creative", "creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)? license", "cc by nc nd 4 0", "creativecommons org licenses by nc nd 4 0"),
    ("odbl-1.0", "database", "open (?:data commons open )?database license(?: (?:v|version )?1 0)?", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "commons", "open data commons attribution license(?: (?:v|version )?1 0)?", "odc by 1 0", "opendatacommons org licenses by"),
    ("pddl-1.0", "dedication", "public domain dedication and license(?: (?:v|version )?1 0)?", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("afl-3.0", "academic", "academic free license(?: (?:v|version )?3 0)?", "afl 3 0", "opensource org licenses afl 3 0"),
    ("osl-3.0", "open", "open software license(?: (?:v|version )?3 0)?", "osl 3 0", "opensource org licenses osl 3 0"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl", "opensource org licenses ms rl"),
    ("w3c", "w3c", "w3c software (?:notice and )?license", "w3c", "w3 org consortium legal software license"),
    ("upl-1.0", "universal", "universal permissive license(?: (?:v|version )?1 0)?", "upl 1 0", "oss oracle com licenses upl"),
)

# Wordings of notices and texts: label, root, keyword, pattern, priority.
WORDINGS = (
    Rule("gpl", "licen", "general", "(?:gnu )?general public license", MENTION),
    Rule("lgpl", "licen", "lesser", "(?:gnu )?lesser general public license", MENTION),
    Rule("apache", "licen", "apache", "apache (?:software )?license", MENTION),
    Rule("bsd", "licen", "bsd", "bsd (?:style )?license", MENTION),
    Rule("mpl", "licen", "mozilla", "mozilla public license", MENTION),
    Rule("epl", "licen", "eclipse", "eclipse public license", MENTION),
    Rule("creative-commons", "licen", "creative", "creative commons(?: [a-z]+){0,3} license", MENTION),
    Rule("mit", "permission", "granted", "permission is hereby granted free of charge to any person obtaining a copy", NOTICE),
    Rule("isc", "permission", "granted", "permission to use copy modify and or distribute this software for any purpose", NOTICE),
    Rule("bsd", "redistribution", "binary", "redistribution and use in source and binary forms(?: with or without modification)?", NOTICE),
    Rule("bsd-3-clause", "endorse", "software", "may be used to endorse or promote products derived from this software", NOTICE),
    Rule("bsd-4-clause", "advertising", "acknowledgement", "all advertising materials mentioning features or use of this software", NOTICE),
    Rule("zlib", "altered", "marked", "altered source versions must be plainly marked as such", NOTICE),
    Rule("bsl-1.0", "transmit", "reproduce", "to use reproduce display distribute execute and transmit the software", NOTICE),
    Rule("gpl", "software", "redistribute", "this program is free software you can redistribute it", NOTICE),
    Rule("gpl-2.0-or-later", "licen", "either", "general public license(?: as published by the free software foundation)? either version 2", NOTICE),
    Rule("gpl-3.0-or-later", "licen", "either", "general public license(?: as published by the free software foundation)? either version 3", NOTICE),
    Rule("cc0-1.0", "waive", "copyright", "waived all copyright and related or neighboring rights", NOTICE),
    Rule("public-domain", "domain", "public", "(?:released|dedicated|placed) (?:in|into|to) the public domain", NOTICE),
    Rule("public-domain", "domain", "public", "(?:is|are) in the public domain", MENTION),
    Rule("unlicense", "domain", "unencumbered", "free and unencumbered software released into the public domain", NOTICE),
    Rule("proprietary", "propriet", "confidential", "proprietary and confidential", NOTICE),
    Rule("proprietary", "permission", "prohibited", "reproduction (?:in whole or in part )?without (?:written )?permission is (?:strictly )?prohibited", NOTICE),
    Rule("proprietary", "rights", "reserved", "copyright(?: c)?(?: [0-9]{4}){1,2}(?: [^ ]+){1,6} all rights reserved", NOTICE),
    Rule("proprietary", "licen", "agreement", "end user license agreement", MENTION),
    Rule("copyright", "copyright", "copyright", "copyright(?: c)? [0-9]{4}", MENTION),
    # bodies: clause openings and sentences that stand in the licenses themselves
    Rule("mit", "permission", "sublicense", "without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies", NOTICE),
    Rule("mit", "permission", "substantial", "permission notice shall be included in all copies or substantial portions of the software", NOTICE),
    Rule("mit", "liab", "dealings", "from out of or in connection with the software or the use or other dealings in the software", MENTION),
    Rule("x11", "advertising", "promote", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", NOTICE),
    Rule("mit-0", "permission", "granted", "permission is hereby granted free of charge to any person obtaining a copy(?: [a-z]+){30,60} and to permit persons to whom the software is furnished to do so the software is provided", NOTICE),
    Rule("isc", "warrant", "disclaims", "the author disclaims all warranties with regard to this software", NOTICE),
    Rule("0bsd", "permission", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", NOTICE),
    Rule("bsd-2-clause", "redistribution", "retain", "redistributions of source code must retain the above copyright notice", NOTICE),
    Rule("bsd-2-clause", "redistribution", "reproduce", "redistributions in binary form must reproduce the above copyright notice", NOTICE),
    Rule("bsd-3-clause", "endorse", "contributors", "neither the names? of (?:the )?(?:[^ ]+ ){1,8}nor the names of (?:its|any|the) contributors may be used to endorse", NOTICE),
    Rule("bsd-4-clause", "acknowledg", "product", "this product includes software developed by(?: [^ ]+){1,8}", MENTION),
    Rule("bsd", "liab", "consequential", "direct indirect incidental special exemplary or consequential damages", MENTION),
    Rule("apache-2.0", "licen", "compliance", "you may not use this file except in compliance with the license", NOTICE),
    Rule("apache-2.0", "licen", "perpetual", "perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", NOTICE),
    Rule("apache-2.0", "licen", "litigation", "institute patent litigation against any entity", NOTICE),
    Rule("apache-2.0", "licen", "derivative", "you must cause any modified files to carry prominent notices stating that you changed the files", NOTICE),
    Rule("apache-2.0", "licen", "governing", "see the license for the specific language governing permissions and limitations under the license", MENTION),
    Rule("apache-1.1", "acknowledg", "apache", "this product includes software developed by the apache software foundation", NOTICE),
    Rule("gpl", "licen", "freedom", "the licenses for most software are designed to take away your freedom to share and change it", NOTICE),
    Rule("gpl", "licen", "copies", "you may copy and distribute verbatim copies of the program s source code", NOTICE),
    Rule("gpl", "licen", "received", "you should have received a copy of the gnu general public license", NOTICE),
    Rule("gpl", "warrant", "fitness", "without even the implied warranty of merchantability or fitness for a particular purpose", MENTION),
    Rule("gpl-2.0", "licen", "distribute", "if you distribute copies of such a program whether gratis or for a fee", NOTICE),
    Rule("gpl-2.0", "licen", "notice", "this license applies to any program or other work which contains a notice placed by the copyright holder", NOTICE),
    Rule("gpl-3.0", "licen", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works", NOTICE),
    Rule("gpl-3.0", "licen", "convey", "to convey a work means any kind of propagation that enables other parties to make or receive copies", NOTICE),
    Rule("gpl-3.0", "licen", "tivo", "installation information for a user product means any methods procedures authorization keys", NOTICE),
    Rule("lgpl", "licen", "lesser", "you should have received a copy of the gnu lesser general public license", NOTICE),
    Rule("lgpl", "library", "linked", "a program that contains no derivative of any portion of the library but is designed to work with the library", NOTICE),
    Rule("lgpl-2.1", "licen", "lesser", "the first released version of the lesser gpl", NOTICE),
    Rule("lgpl-3.0", "library", "combined", "a combined work is a work produced by combining or linking an application with the library", NOTICE),
    Rule("agpl-3.0", "affero", "network", "if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network", NOTICE),
    Rule("agpl-3.0", "affero", "received", "you should have received a copy of the gnu affero general public license", NOTICE),
    Rule("gfdl", "document", "invariant", "with no invariant sections no front cover texts and no back cover texts", NOTICE),
    Rule("gfdl", "document", "permission", "permission is granted to copy distribute and or modify this document", NOTICE),
    Rule("mpl-2.0", "mozilla", "source", "this source code form is subject to the terms of the mozilla public license v 2 0", NOTICE),
    Rule("mpl-2.0", "covered", "secondary", "this source code form is incompatible with secondary licenses as defined by", NOTICE),
    Rule("mpl-1.1", "mozilla", "contents", "the contents of this file are subject to the mozilla public license version 1 1", NOTICE),
    Rule("mpl", "covered", "modifications", "you must cause all covered code to which you contribute to contain a file documenting the changes", NOTICE),
    Rule("epl", "eclipse", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license", NOTICE),
    Rule("epl", "agreement", "recipient", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement", NOTICE),
    Rule("zlib", "warrant", "implied", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", NOTICE),
    Rule("zlib", "origin", "misrepresented", "the origin of this software must not be misrepresented", NOTICE),
    Rule("libpng", "origin", "png", "the contributing authors and group 42 inc", NOTICE),
    Rule("bsl-1.0", "boost", "software", "boost software license version 1 0 august 17th 2003", NOTICE),
    Rule("artistic-2.0", "artistic", "package", "the copyright holder intends that the package as a whole may be distributed under the terms of the artistic license", NOTICE),
    Rule("artistic", "package", "standard", "you may make and give away verbatim copies of the source form of the standard version of this package", NOTICE),
    Rule("ofl-1.1", "font", "reserved", "the font software may be modified altered or added to", NOTICE),
    Rule("ofl-1.1", "font", "sold", "neither the font software nor any of its individual components in original or modified versions may be sold by itself", NOTICE),
    Rule("wtfpl", "fuck", "want", "you just do what the fuck you want to", NOTICE),
    Rule("unlicense", "domain", "dedicate", "the author or authors of this software dedicate any and all copyright interest in the software to the public domain", NOTICE),
    Rule("unlicense", "anyone", "compile", "anyone is free to copy modify publish use compile sell or distribute this software", NOTICE),
    Rule("cc0-1.0", "affirm", "waive", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders all of affirmer s copyright", NOTICE),
    Rule("cc-by", "attribution", "credit", "you must give appropriate credit provide a link to the license and indicate if changes were made", NOTICE),
    Rule("cc-by-sa", "remix", "contributions", "if you remix transform or build upon the material you must distribute your contributions under the same license", NOTICE),
    Rule("cc-by-nc", "commercial", "material", "you may not use the material for commercial purposes", NOTICE),
    Rule("cc-by-nd", "remix", "material", "if you remix transform or build upon the material you may not distribute the modified material", NOTICE),
    Rule("creative-commons", "adapt", "attribution", "by exercising the licensed rights(?: defined below)? you accept and agree to be bound", NOTICE),
    Rule("odbl-1.0", "database", "derivative", "any derivative database that you publicly use must be only under the terms", NOTICE),
    Rule("openssl", "openssl", "toolkit", "this product includes software developed by the openssl project", NOTICE),
    Rule("php-3.01", "php", "freely", "this product includes php software freely available from", NOTICE),
    Rule("python-2.0", "python", "psf", "this license agreement is between the python software foundation", NOTICE),
    Rule("ruby", "ruby", "gpl", "you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl)", NOTICE),
    Rule("curl", "permission", "curl", "copyright(?: c)? [0-9]{4}(?: [0-9]{4})? daniel stenberg", NOTICE),
    Rule("beerware", "beer", "stuff", "you can buy me a beer in return", NOTICE),
    Rule("json", "evil", "good", "the software shall be used for good not evil", NOTICE),
    Rule("commons-clause", "sell", "commons", "the license does not grant to you the right to sell the software", NOTICE),
    Rule("sspl-1.0", "service", "program", "if you make the functionality of the program or a modified version available to third parties as a service", NOTICE),
    Rule("busl-1.1", "production", "licensor", "the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", NOTICE),
    Rule("proprietary", "propriet", "trade", "(?:contains|constitutes|is) (?:the )?(?:confidential|proprietary|trade secret) (?:and proprietary )?information", NOTICE),
    Rule("proprietary", "copying", "unauthori", "unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: (?:or|and) (?:copying|use|reproduction|distribution))? of this (?:file|software|document|material|program)", NOTICE),
    Rule("proprietary", "reproduc", "transmitted", "no part of this (?:publication|book|document|work|material) may be reproduced", NOTICE),
    Rule("proprietary", "licen", "revers", "(?:may not|shall not|agree not to) (?:copy modify )?reverse engineer decompile or disassemble", NOTICE),
    Rule("proprietary", "licen", "installing", "by installing (?:copying )?or (?:otherwise )?using (?:this|the) software you agree to", NOTICE),
    Rule("proprietary", "propriet", "internal", "for internal use only", MENTION),
    Rule("public-domain", "domain", "waive", "no copyright is claimed|no rights reserved", NOTICE),
    Rule("us-government", "government", "united", "work of the united states government|united states government work", NOTICE),
    Rule("warranty-disclaimer", "warrant", "warrant", "without warranties or conditions of any kind", MENTION),
    Rule("warranty-disclaimer", "warrant", "warrant", "provided as is without warranty of any kind", MENTION),
    Rule("warranty-disclaimer", "warrant", "merchantability", "implied warrant(?:y|ies) of merchantability", MENTION),
)


_ANY_LICENSE = "(?:[^ ]+ ){0,8}licen[cs]es?(?: (?:v|version ?)?[0-9]+(?: [0-9]+)?)?"
# Wordings that speak of a license and grant nothing: root, keyword, pattern.
SILENCED = tuple(
    Rule("", root, key, pattern, SILENCE)
    for root, key, pattern in (
        ("licen", "not", f"(?:not|never|no longer) (?:be )?(?:licensed|released|distributed|available|published|covered) under (?:the )?(?:terms of (?:the )?)?{_ANY_LICENSE}"),
        ("licen", "not", f"(?:is|are|was|were) not (?:compatible with |subject to )?(?:the |a |an )?{_ANY_LICENSE}"),
        ("licen", "compatible", f"incompatible with (?:the )?{_ANY_LICENSE}"),
        ("licen", "unlike", f"unlike (?:the )?{_ANY_LICENSE}"),
        ("licen", "instead", f"instead of (?:the )?{_ANY_LICENSE}"),
        ("licen", "rather", f"rather than (?:the )?{_ANY_LICENSE}"),
        ("licen", "compar", f"compared (?:to|with) (?:the )?{_ANY_LICENSE}"),
        ("licen", "histor", f"(?:the )?history of (?:the )?{_ANY_LICENSE}"),
        ("licen", "plate", "(?:driver s|driving|number|fishing|hunting|marriage|liquor) licen[cs]es?(?: plates?)?"),
        ("domain", "not", "(?:is|are|was|were) not in the public domain"),
    )
)


def signatures() -> tuple[Rule, ...]:
    """All rules in order: for each license its identifier, address, notices and name; then the wordings; then what silences."""
    rules = []
    for label, key, name, identifier, address in LICENSES:
        rules += [
            Rule(label, "spdx", "identifier", f"spdx license identifier {identifier}", IDENTIFIER),
            Rule(label, "licen" if "licen" in address else address.split()[0], address.split()[0], f"(?:www )?{address.lower()}(?: txt| html)?", IDENTIFIER),
            Rule(label, "licen", key, f"(?:licensed|released|distributed|available|published|covered|redistribute it) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}", NOTICE),
            Rule(label, "licen", key, f"subject to (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{name}", NOTICE),
            Rule(label, "licen", key, name, MENTION),
        ]
        if " " in identifier:  # one-word identifiers are words of everyday texts
            rules.append(Rule(label, "licen", "licen", f"licen[cs]e (?:is )?{identifier}", NOTICE))
    return (*rules, *WORDINGS, *SILENCED)


RULES = signatures()
DETECTION = "array<struct<start:bigint,order_end:bigint,order_priority:int,rule:int,label:string>>"


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def places(words: Column, pattern: Column | str) -> Column:
    """(start, end) in words of every match. ``words`` has one space before and after each word."""
    bounded = F.concat(F.lit("(?<= )(?:"), pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(")(?= )"))
    return F.transform(
        find_all(words, bounded, _spaces),
        lambda m: F.struct((m["start"] - 1).alias("start"), (m["start"] + _spaces(m["match"])).alias("end")),
    )


def settle(found: Column) -> Column:
    """Drops each detection that lies within another one of the same or a higher priority.

    In order of start, longest first, a detection is contained if the furthest
    end of those before it, of its priority or higher, reaches its own end. Of
    equal intervals the first rule of the highest priority stays. Detections that silence are left out at the end.
    """

    def ranked(d: Column) -> Column:
        def reach(priority: int) -> Column:
            ends = F.transform(d, lambda x: F.when(-x["order_priority"] >= priority, -x["order_end"]).otherwise(-1))
            return prefixes(ends, lambda a, b: F.greatest(a, b), -1)

        return let(
            F.struct(*(reach(p).alias(f"r{p}") for p in (MENTION, NOTICE, IDENTIFIER, SILENCE))),
            lambda r: F.transform(
                F.filter(
                    indexes(d),
                    lambda i: (F.get(d, i)["order_priority"] > -SILENCE)
                    & (F.get(
                        F.when(F.get(d, i)["order_priority"] == -IDENTIFIER, r[f"r{IDENTIFIER}"])
                        .when(F.get(d, i)["order_priority"] == -NOTICE, r[f"r{NOTICE}"])
                        .otherwise(r[f"r{MENTION}"]),
                        i,
                    )
                    < -F.get(d, i)["order_end"]),
                ),
                lambda i: F.struct(
                    F.get(d, i)["start"].alias("start"),
                    (-F.get(d, i)["order_end"]).alias("end"),
                    (-F.get(d, i)["order_priority"]).alias("priority"),
                    F.get(d, i)["label"].alias("label"),
                ),
            ),
        )

    return let(F.array_sort(found), ranked)


def licenses(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``_licenses``: n_words, ``base`` (start, end, label) and ``found`` (start, end, priority, label), in words from 0.

    Words are runs of letters and digits, A-Z in lower case. ``base`` holds
    every place of the base phrases, in order of start. ``found`` holds what the
    ordered rules detect and ``settle`` leaves. A rule is tried only on texts that contain
    its root and its keyword; most texts contain no root and are only counted.

    A null text reads as empty: no words, no detections. Repeated rows are scanned
    each for itself. All columns of ``docs`` are kept; a column called
    ``_licenses`` is replaced. No shuffle, no Python.
    """
    roots = sorted({r.root for r in rules})
    # Constant arrays, one per field: a rule is a place in them.
    column = lambda values: F.split(F.lit("\n".join(map(str, values))), "\n", -1)
    root_at, key_at, label_at = (column(getattr(r, f) for r in rules) for f in ("root", "key", "label"))
    pattern_at = column(f"(?i:{r.pattern})" for r in rules)
    priority_at = column(r.priority for r in rules).cast("array<int>")

    def base(words: Column) -> Column:
        def of(phrase: str, label: str) -> Column:
            return F.transform(
                places(words, f"(?i:{phrase})"),
                lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(label).alias("label")),
            )

        return F.array_sort(F.concat(*(of(*x) for x in BASE.items())))

    def found(words: Column, lower: Column, near: Column) -> Column:
        tried = F.filter(
            F.sequence(F.lit(0), F.lit(len(rules) - 1)),
            lambda i: F.array_contains(near, F.get(root_at, i)) & lower.contains(F.get(key_at, i)),
        )
        detections = F.flatten(
            F.transform(
                tried,
                lambda i: F.transform(
                    places(words, F.get(pattern_at, i)),
                    lambda m: F.struct(
                        m["start"].alias("start"),
                        (-m["end"]).alias("order_end"),
                        (-F.get(priority_at, i)).alias("order_priority"),
                        i.alias("rule"),
                        F.get(label_at, i).alias("label"),
                    ),
                ),
            )
        )
        return settle(detections.cast(DETECTION))

    def scanned(t: Column) -> Column:
        words = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, BETWEEN, " ")), F.lit(" "))
        none = F.struct(
            F.array().cast("array<struct<start:bigint,end:bigint,label:string>>").alias("base"),
            F.array().cast("array<struct<start:bigint,end:bigint,priority:int,label:string>>").alias("found"),
        )

        def gated(lower: Column) -> Column:
            near = F.filter(column(roots), lambda r: lower.contains(r))
            maybe_base = (lower.contains("cc") & lower.contains("by")) | lower.contains("reserved") | lower.contains("general")
            return let(
                near,
                lambda n: F.when(
                    (F.size(n) > 0) | maybe_base,
                    let(words, lambda w: F.struct(base(w).alias("base"), found(w, lower, n).alias("found"))),
                ).otherwise(none),
            )

        return let(
            let(F.lower(t), gated),
            lambda g: F.struct(
                F.regexp_count(t, F.lit(WORD)).cast("bigint").alias("n_words"),
                g["base"].alias("base"),
                g["found"].alias("found"),
            ),
        )

    return with_one(docs, "_licenses", let(whole_text(text), scanned))


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document with the contract's columns, and the detections' number and list.

    ``score`` is the highest confidence among what was found: 1 for an
    identifier or address, 0.9 for a notice, 0.6 for a mention, 0.5 for a base phrase alone.
    """
    x = F.col("_licenses")
    labels = lambda *parts: F.array_join(F.array_sort(F.array_distinct(F.concat(*parts))), ",")
    confidence = F.transform(
        x["found"],
        lambda d: F.when(d["priority"] == IDENTIFIER, CONFIDENCE[IDENTIFIER])
        .when(d["priority"] == NOTICE, CONFIDENCE[NOTICE])
        .otherwise(CONFIDENCE[MENTION]),
    )
    return licenses(docs.select("doc_id", "text")).select(
        "doc_id",
        x["n_words"].alias("n_words"),
        F.size(x["base"]).cast("bigint").alias("n_base"),
        F.get(x["base"], F.lit(0))["start"].alias("first_word"),
        F.array_max(F.transform(x["base"], lambda b: b["start"])).alias("last_word"),
        labels(x["base"]["label"]).alias("base_labels"),
        labels(x["base"]["label"], x["found"]["label"]).alias("labels"),
        F.coalesce(
            F.array_max(confidence), F.when(F.size(x["base"]) > 0, F.lit(BASE_CONFIDENCE)), F.lit(0.0)
        ).cast("double").alias("score"),
        F.size(x["found"]).cast("bigint").alias("n_found"),
        F.array_join(
            F.transform(x["found"], lambda d: F.concat_ws(":", d["label"], d["start"].cast("string"), d["end"].cast("string"))),
            ",",
        ).alias("found"),
    )
