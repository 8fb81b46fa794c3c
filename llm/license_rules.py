"""Signature rules of the license scan, over lower-case words between single blanks.

A rule has a priority (1 strongest), a label, a keyword that any match contains at
the start of a word, and a regular expression. Most families are written once, as (label, keyword,
name), and stand in each of FORMS; order within a priority is rule order.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    keyword: str
    pattern: str


#: How a license's name stands in a text: in a grant, under a tag, on its own.
FORMS = (
    (1, "(?:licensed|licenced|released|distributed|published|provided|available|redistributed) under(?: the)?(?: terms| conditions)?(?: and conditions)?(?: of)?(?: the)? {name}"),
    (1, "spdx license identifier {name}"),
    (1, "(?:subject to|governed by|covered by|in accordance with)(?: the)?(?: terms)?(?: and conditions)?(?: of)?(?: the)? {name}"),
    (2, "{name}"),
)

_GNU = " ?(?:as published by the free software foundation )?(?:either )?(?:version |v ?)"
_OR_LATER = "(?: or (?:any |at your option any )?later(?: version)?| or later| only)?"

FAMILIES = [
    ("apache-2.0", "apache", "apache (?:software )?(?:license |licence )?(?:version |v ?)?2(?: 0)?"),
    ("apache-1.1", "apache", "apache (?:software )?(?:license |licence )?(?:version |v ?)?1 1"),
    ("apache-1.0", "apache", "apache (?:software )?(?:license |licence )?(?:version |v ?)?1 0"),
    ("mit", "mit licen", "mit (?:license|licence)"),
    ("mit", "expat", "expat (?:license|licence)"),
    ("mit-0", "mit 0", "mit 0(?: license)?"),
    ("mit-0", "no attribution", "mit no attribution(?: license)?"),
    ("x11", "x11", "(?:mit )?x11 (?:license|licence)"),
    ("isc", "isc licen", "isc (?:license|licence)"),
    ("0bsd", "0bsd", "0bsd(?: license)?"),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause)(?: license)?"),
    ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: license)?"),
    ("bsd-2-clause", "freebsd", "freebsd license"),
    ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: license)?"),
    ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: license)?"),
    ("gpl-1.0", "gpl", f"gpl ?(?:version |v ?)?1(?: 0)?{_OR_LATER}"),
    ("gpl-2.0", "gpl", f"gpl ?(?:version |v ?)?2(?: 0)?{_OR_LATER}"),
    ("gpl-3.0", "gpl", f"gpl ?(?:version |v ?)?3(?: 0)?{_OR_LATER}"),
    ("gpl-1.0", "gnu", f"gnu general public (?:license|licence){_GNU}1(?: 0)?{_OR_LATER}"),
    ("gpl-2.0", "gnu", f"gnu general public (?:license|licence){_GNU}2(?: 0)?{_OR_LATER}"),
    ("gpl-3.0", "gnu", f"gnu general public (?:license|licence){_GNU}3(?: 0)?{_OR_LATER}"),
    ("lgpl-2.0", "lgpl", f"lgpl ?(?:version |v ?)?2(?: 0)?{_OR_LATER}"),
    ("lgpl-2.1", "lgpl", f"lgpl ?(?:version |v ?)?2 1{_OR_LATER}"),
    ("lgpl-3.0", "lgpl", f"lgpl ?(?:version |v ?)?3(?: 0)?{_OR_LATER}"),
    ("lgpl-2.0", "gnu", f"gnu (?:lesser|library) general public (?:license|licence){_GNU}2(?: 0)?{_OR_LATER}"),
    ("lgpl-2.1", "gnu", f"gnu (?:lesser|library) general public (?:license|licence){_GNU}2 1{_OR_LATER}"),
    ("lgpl-3.0", "gnu", f"gnu (?:lesser|library) general public (?:license|licence){_GNU}3(?: 0)?{_OR_LATER}"),
    ("agpl-3.0", "agpl", f"agpl ?(?:version |v ?)?3(?: 0)?{_OR_LATER}"),
    ("agpl-3.0", "affero", f"(?:gnu )?affero general public (?:license|licence){_GNU}3(?: 0)?{_OR_LATER}"),
    ("gfdl-1.1", "free documentation", f"(?:gnu )?free documentation license{_GNU}1 1{_OR_LATER}"),
    ("gfdl-1.2", "free documentation", f"(?:gnu )?free documentation license{_GNU}1 2{_OR_LATER}"),
    ("gfdl-1.3", "free documentation", f"(?:gnu )?free documentation license{_GNU}1 3{_OR_LATER}"),
    ("mpl-1.0", "mozilla", "mozilla public (?:license|licence) (?:version |v ?)?1 0"),
    ("mpl-1.1", "mozilla", "mozilla public (?:license|licence) (?:version |v ?)?1 1"),
    ("mpl-2.0", "mozilla", "mozilla public (?:license|licence) (?:version |v ?)?2(?: 0)?"),
    ("mpl-1.1", "mpl", "mpl ?(?:version |v ?)?1 1"),
    ("mpl-2.0", "mpl", "mpl ?(?:version |v ?)?2(?: 0)?"),
    ("epl-1.0", "eclipse", "eclipse public (?:license|licence) (?:version |v ?)?1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public (?:license|licence) (?:version |v ?)?2(?: 0)?"),
    ("cddl-1.0", "common development", "common development and distribution (?:license|licence)(?: (?:version |v ?)?1 0)?"),
    ("cddl-1.1", "common development", "common development and distribution (?:license|licence) (?:version |v ?)?1 1"),
    ("cpl-1.0", "common public", "common public (?:license|licence)(?: (?:version |v ?)?1 0)?"),
    ("artistic-1.0", "artistic", "artistic (?:license|licence) (?:version |v ?)?1(?: 0)?"),
    ("artistic-2.0", "artistic", "artistic (?:license|licence) (?:version |v ?)?2(?: 0)?"),
    ("zlib", "zlib", "zlib(?: libpng)? (?:license|licence)"),
    ("libpng", "libpng", "libpng (?:license|licence)(?: version 2)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("wtfpl", "what the fuck", "do what the fuck you want to public license"),
    ("bsl-1.0", "boost", "boost software (?:license|licence)(?: (?:version |v ?)?1 0)?"),
    ("ms-pl", "microsoft", "microsoft public (?:license|licence)"),
    ("ms-rl", "microsoft", "microsoft reciprocal (?:license|licence)"),
    ("eupl-1.1", "european union", "european union public (?:license|licence) (?:version |v ?)?1 1"),
    ("eupl-1.2", "european union", "european union public (?:license|licence) (?:version |v ?)?1 2"),
    ("ofl-1.1", "open font", "(?:sil )?open font (?:license|licence)(?: (?:version |v ?)?1 1)?"),
    ("odbl-1.0", "open database", "open database (?:license|licence)(?: (?:version |v ?)?1 0)?"),
    ("odc-by-1.0", "open data commons", "open data commons attribution(?: license)?"),
    ("pddl-1.0", "public domain dedication", "(?:open data commons )?public domain dedication and (?:license|licence)"),
    ("python-2.0", "python", "python(?: software foundation)? (?:license|licence)(?: version 2)?"),
    ("php-3.01", "php licen", "php (?:license|licence)(?: (?:version |v ?)?3 01)?"),
    ("postgresql", "postgresql", "postgresql (?:license|licence)"),
    ("openssl", "openssl", "openssl (?:license|licence)"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? (?:license|licence)"),
    ("ecl-2.0", "educational community", "educational community (?:license|licence)(?: (?:version |v ?)?2 0)?"),
    ("afl-3.0", "academic free", "academic free (?:license|licence)(?: (?:version |v ?)?3 0)?"),
    ("osl-3.0", "open software", "open software (?:license|licence)(?: (?:version |v ?)?3 0)?"),
    ("upl-1.0", "universal permissive", "universal permissive (?:license|licence)(?: (?:version |v ?)?1 0)?"),
    ("vim", "vim licen", "vim (?:license|licence)"),
    ("json", "json", "json (?:license|licence)"),
    ("beerware", "beerware", "beerware(?: license)?"),
    ("ruby", "ruby", "ruby (?:license|licence)"),
    ("w3c", "w3c", "w3c software(?: notice)?(?: and)?(?: document)? (?:license|licence|notice)"),
    ("unicode-dfs", "unicode", "unicode(?: inc)? (?:license|licence)(?: agreement)?"),
    ("sspl-1.0", "server side", "server side public (?:license|licence)(?: (?:version |v ?)?1)?"),
    ("busl-1.1", "business source", "business source (?:license|licence)(?: (?:version |v ?)?1 1)?"),
    ("elastic-2.0", "elastic", "elastic (?:license|licence)(?: (?:version |v ?)?2(?: 0)?)?"),
    ("cecill-2.1", "cecill", "cecill(?: free software license agreement)?(?: (?:version |v ?)?2 1)?"),
    ("mulanpsl-2.0", "mulan", "mulan permissive software (?:license|licence)(?: (?:version |v ?)?2)?"),
    ("blueoak-1.0.0", "blue oak", "blue oak model (?:license|licence)(?: 1 0 0)?"),
    ("polyform-nc", "polyform", "polyform noncommercial(?: license)?"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons", "creative commons (?:zero|cc0)(?: 1 0)?(?: universal)?"),
]

#: Parts of a Creative Commons name, short and long.
CC_PARTS = {
    "by": ("by", "attribution"),
    "nc": ("nc", "non ?commercial"),
    "nd": ("nd", "no ?deriv(?:ative)?s?(?: works)?"),
    "sa": ("sa", "share ?alike"),
}
CC_KINDS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

for _kind in CC_KINDS:
    _short = " ".join(CC_PARTS[part][0] for part in _kind.split("-"))
    _long = " ".join(CC_PARTS[part][1] for part in _kind.split("-"))
    for _version in (*CC_VERSIONS, ""):
        _number = " (?:version |v ?)?" + _version.replace(".", " ") + "(?: international| unported)?" if _version else ""
        _label = f"cc-{_kind}" + (f"-{_version}" if _version else "")
        FAMILIES.append((_label, "cc by", f"cc {_short}{_number}(?: license)?"))
        FAMILIES.append((_label, "creative commons", f"creative commons (?:{_short}|{_long})(?: license)?{_number}"))

_ONLY = "(?: only| or later)?"
#: SPDX ids that the names above do not match, as words: (label, id, verbs of a grant).
#: "in use": what is "available under Python" is no license, so only "licensed under" counts.
SPDX_IDS = [
    ("mit", "mit", "any"),
    ("isc", "isc", "any"),
    ("zlib", "zlib", "any"),
    ("x11", "x11", "in use"),
    ("libpng", "libpng(?: 2 0)?", "in use"),
    ("epl-1.0", "epl 1 0", "any"),
    ("epl-2.0", "epl 2 0", "any"),
    ("cddl-1.0", "cddl 1 0", "any"),
    ("cddl-1.1", "cddl 1 1", "any"),
    ("cpl-1.0", "cpl 1 0", "any"),
    ("mpl-1.0", "mpl 1 0", "any"),
    ("artistic-1.0", "artistic 1 0(?: perl| cl8)?", "any"),
    ("artistic-2.0", "artistic 2 0", "any"),
    ("bsl-1.0", "bsl 1 0", "any"),
    ("ms-pl", "ms pl", "any"),
    ("ms-rl", "ms rl", "any"),
    ("eupl-1.1", "eupl 1 1", "any"),
    ("eupl-1.2", "eupl 1 2", "any"),
    ("ofl-1.1", "ofl 1 1(?: rfn| no rfn)?", "any"),
    ("odbl-1.0", "odbl 1 0", "any"),
    ("odc-by-1.0", "odc by 1 0", "any"),
    ("pddl-1.0", "pddl 1 0", "any"),
    ("python-2.0", "python 2 0(?: 1)?", "in use"),
    ("python-2.0", "psf 2 0", "any"),
    ("php-3.01", "php 3 01", "in use"),
    ("postgresql", "postgresql", "in use"),
    ("openssl", "openssl", "in use"),
    ("ncsa", "ncsa", "any"),
    ("ecl-2.0", "ecl 2 0", "any"),
    ("afl-3.0", "afl 3 0", "any"),
    ("osl-3.0", "osl 3 0", "any"),
    ("upl-1.0", "upl 1 0", "any"),
    ("vim", "vim", "in use"),
    ("json", "json", "in use"),
    ("ruby", "ruby", "in use"),
    ("w3c", "w3c", "in use"),
    ("unicode-dfs", "unicode dfs", "any"),
    ("sspl-1.0", "sspl 1 0", "any"),
    ("busl-1.1", "busl 1 1", "any"),
    ("elastic-2.0", "elastic 2 0", "any"),
    ("mulanpsl-2.0", "mulanpsl 2 0", "any"),
    ("blueoak-1.0.0", "blueoak 1 0 0", "any"),
    ("gfdl-1.1", f"gfdl 1 1(?: invariants| no invariants)?{_ONLY}", "any"),
    ("gfdl-1.2", f"gfdl 1 2(?: invariants| no invariants)?{_ONLY}", "any"),
    ("gfdl-1.3", f"gfdl 1 3(?: invariants| no invariants)?{_ONLY}", "any"),
]
_VERBS = {"any": "(?:licensed|licenced|released|distributed|published|provided|available|redistributed)", "in use": "(?:licensed|licenced)"}
_TERMS = "(?: terms| conditions)?(?: and conditions)?"


def _of_id(label: str, name: str, verbs: str) -> list[Rule]:
    """An id under a tag, in grants and before "licensed"; keywords are short of words that stand in any text."""
    first = name.split("(")[0]
    grant = f"{_VERBS[verbs]} under"
    return [
        Rule(1, label, "spdx license identifier", f"spdx license identifier {name}"),
        Rule(1, label, f"under {first}", f"{grant} {name}"),
        Rule(1, label, f"the {first}", f"{grant} the {name}"),
        Rule(1, label, f"of {first}", f"{grant}(?: the)?{_TERMS} of {name}"),
        Rule(1, label, f"of the {first}", f"{grant}(?: the)?{_TERMS} of the {name}"),
        Rule(1, label, f"{first} licen" if first == name else first, f"{name} (?:licensed|licenced)"),
    ]


#: Names without a version and sentences of license texts.
SINGLE = [
    Rule(3, "gpl", "gpl", "gpl"),
    Rule(3, "gpl", "gnu", "gnu general public (?:license|licence)"),
    Rule(3, "lgpl", "lgpl", "lgpl"),
    Rule(3, "lgpl", "gnu", "gnu (?:lesser|library) general public (?:license|licence)"),
    Rule(3, "agpl", "agpl", "agpl"),
    Rule(3, "agpl", "affero", "(?:gnu )?affero general public (?:license|licence)"),
    Rule(3, "apache", "apache", "apache (?:software )?(?:license|licence)"),
    Rule(3, "bsd", "bsd", "bsd (?:style )?(?:license|licence)"),
    Rule(3, "mpl", "mozilla", "mozilla public (?:license|licence)"),
    Rule(3, "epl", "eclipse", "eclipse public (?:license|licence)"),
    Rule(3, "artistic", "artistic", "artistic (?:license|licence)"),
    Rule(3, "eupl", "european union", "european union public (?:license|licence)"),
    Rule(3, "gfdl", "free documentation", "(?:gnu )?free documentation license"),
    Rule(3, "creative-commons", "creative commons", "creative commons(?: license)?"),
    Rule(3, "public-domain", "public domain", "(?:in|into|to) the public domain"),
    Rule(3, "all-rights-reserved", "rights reserved", "all rights reserved"),
    Rule(1, "mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Rule(1, "isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Rule(1, "bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    Rule(1, "gpl", "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Rule(1, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    Rule(1, "zlib", "express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
]

RULES = [
    *(Rule(priority, label, keyword, form.format(name=f"(?:{name})")) for label, keyword, name in FAMILIES for priority, form in FORMS),
    *SINGLE,
    *(rule for of_id in SPDX_IDS for rule in _of_id(*of_id)),
]
