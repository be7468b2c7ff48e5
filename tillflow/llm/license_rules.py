"""Signature rules of licences and notices, written over normalised words.

A rule's pattern is a regular expression over the lower-cased words of a text joined by single spaces; ``#``
stands for any version number, whose digits normalisation has put apart as words. Higher priority is the
stronger statement: a full grant or identifier over a named licence, a named licence over a loose mention.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Phrases that always count, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_PRIORITY = 40

GRANT, IDENTIFIER, NAMED, NOTICE, MENTION = 90, 80, 60, 50, 30

VERSION = r"(?: (?:version|v|ver))? ?(?:v)?\d(?: \d){0,2}"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int


def _rules() -> list[Rule]:
    out: list[Rule] = []

    def add(label: str, keyword: str, pattern: str, priority: int) -> None:
        out.append(Rule(label, keyword, pattern.replace("#", VERSION), priority))

    # Licences that exist in numbered versions: how they are called, and the versions.
    for label, keyword, names, versions in (
        ("apache", "apache", "apache (?:software )?licen[sc]e", ("1 0", "1 1", "2 0")),
        ("gpl", "general public", "(?:gnu )?general public licen[sc]e", ("1", "2", "3", "2 0", "3 0")),
        ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public licen[sc]e",
         ("2", "2 0", "2 1", "3", "3 0")),
        ("agpl", "affero", "(?:gnu )?affero general public licen[sc]e", ("1", "1 0", "3", "3 0")),
        ("gpl", "gpl", "gnu gpl", ("1", "2", "3", "2 0", "3 0")),
        ("lgpl", "lgpl", "(?:gnu )?lgpl", ("2", "2 1", "3", "3 0")),
        ("agpl", "agpl", "(?:gnu )?agpl", ("1", "3", "3 0")),
        ("gfdl", "documentation", "(?:gnu )?free documentation licen[sc]e", ("1 1", "1 2", "1 3")),
        ("mpl", "mozilla", "mozilla public licen[sc]e", ("1 0", "1 1", "2 0")),
        ("epl", "eclipse", "eclipse public licen[sc]e", ("1 0", "2 0")),
        ("cpl", "common public", "common public licen[sc]e", ("0 5", "1 0")),
        ("cddl", "common development", "common development and distribution licen[sc]e", ("1 0", "1 1")),
        ("eupl", "european union", "european union public licen[sc]e", ("1 0", "1 1", "1 2")),
        ("osl", "open software", "open software licen[sc]e", ("1 0", "2 0", "2 1", "3 0")),
        ("afl", "academic free", "academic free licen[sc]e", ("1 1", "2 0", "2 1", "3 0")),
        ("artistic", "artistic", "artistic licen[sc]e", ("1 0", "2 0")),
        ("apsl", "apple public", "apple public source licen[sc]e", ("1 0", "1 2", "2 0")),
        ("boost", "boost", "boost software licen[sc]e", ("1 0",)),
        ("ofl", "open font", "(?:sil )?open font licen[sc]e", ("1 0", "1 1")),
        ("cecill", "cecill", "cecill(?: free software licen[sc]e agreement)?", ("1 0", "1 1", "2 0", "2 1")),
        ("lppl", "latex project", "latex project public licen[sc]e", ("1 0", "1 2", "1 3")),
        ("php", "php", "php licen[sc]e", ("3 0", "3 01")),
        ("psf", "python software", "python software foundation licen[sc]e", ("2",)),
        ("zpl", "zope", "zope public licen[sc]e", ("1 1", "2 0", "2 1")),
        ("qpl", "qpl", "qpl", ("1 0",)),
        ("rpl", "reciprocal public", "reciprocal public licen[sc]e", ("1 1", "1 5")),
        ("upl", "universal permissive", "universal permissive licen[sc]e", ("1 0",)),
        ("ecl", "educational community", "educational community licen[sc]e", ("1 0", "2 0")),
        ("odc-by", "open data", "open data commons attribution licen[sc]e", ("1 0",)),
        ("odbl", "open database", "open database licen[sc]e", ("1 0",)),
        ("ms-pl", "microsoft public", "microsoft public licen[sc]e", ("1 0",)),
        ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[sc]e", ("1 0",)),
    ):
        for version in versions:
            add(f"{label}-{version.replace(' ', '.')}", keyword,
                f"{names}(?: version| v)? ?(?:v)?{version}(?! \\d)", NAMED)
            add(f"{label}-{version.replace(' ', '.')}-or-later", keyword,
                f"{names}(?: version| v)? ?(?:v)?{version} or (?:any )?(?:at your option any )?later(?: version)?",
                NAMED + 5)
        add(label, keyword, names, MENTION + 5)
        add(label, keyword, f"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?"
                            f"(?:the )?{names}(?:#)?", NAMED - 2)

    # Creative Commons: the elements, in words and short.
    for label, words in (("by", "attribution"), ("by-sa", "attribution share ?alike"),
                         ("by-nc", "attribution non ?commercial"), ("by-nd", "attribution no ?deriv(?:ative)?s?"),
                         ("by-nc-sa", "attribution non ?commercial share ?alike"),
                         ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?")):
        short = "cc " + label.replace("-", " ")
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            add(f"cc-{label}-{version.replace(' ', '.')}", "cc by", f"{short} {version}", NAMED + 5)
            add(f"cc-{label}-{version.replace(' ', '.')}", "creative commons",
                f"creative commons {words} {version}", NAMED + 5)
        add(f"cc-{label}", "cc by", short, NAMED - 5)
        add(f"cc-{label}", "creative commons", f"creative commons {words}", NAMED - 5)
        add(f"cc-{label}", "creativecommons", f"creativecommons org licenses {label.replace('-', ' ')}(?: \\d \\d)?",
            IDENTIFIER)
    add("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?", NAMED)
    add("cc0", "creativecommons", "creativecommons org publicdomain zero 1 0", IDENTIFIER)
    add("cc", "creative commons", "creative commons(?: licen[sc]e)?", MENTION)

    # Machine-readable identifiers.
    for name in ("mit", "isc", "zlib", "unlicense", "wtfpl", "ncsa", "postgresql", "x11", "0bsd", "blessing",
                 "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "apache 1 1", "apache 2 0", "gpl 2 0 only",
                 "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later", "lgpl 2 1 only", "lgpl 2 1 or later",
                 "lgpl 3 0 only", "lgpl 3 0 or later", "agpl 3 0 only", "agpl 3 0 or later", "mpl 1 1", "mpl 2 0",
                 "epl 1 0", "epl 2 0", "cddl 1 0", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "bsl 1 0", "artistic 2 0"):
        add("spdx-" + name.replace(" ", "-"), "spdx", f"spdx license identifier {name}", IDENTIFIER + 5)
    add("spdx", "spdx", "spdx license identifier", IDENTIFIER - 10)

    # Full texts and grants.
    for label, keyword, pattern in (
        ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
        ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose"),
        ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification"),
        ("bsd-3-clause", "neither the name", "neither the name of (?:the )?(?:\\S+ ){1,8}nor the names of its contributors"),
        ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software"),
        ("zlib", "express or implied", "this software is provided as is without any express or implied warranty"),
        ("apache", "apache", "you may not use this file except in compliance with the license"),
        ("gpl", "redistribute it", "you can redistribute it and or modify it under the terms of the gnu general public license"),
        ("lgpl", "redistribute it", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
        ("agpl", "redistribute it", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
        ("mpl", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
        ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
        ("wtfpl", "want to", "you just do what the \\S+ you want to"),
        ("boost", "boost", "distributed under the boost software license version 1 0"),
        ("epl", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
        ("gfdl", "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
        ("warranty-disclaimer", "warranty", "without warranty of any kind express or implied"),
        ("warranty-disclaimer", "warranty", "without warranties or conditions of any kind"),
        ("warranty-disclaimer", "merchantability", "merchantability (?:and|or) fitness for a particular purpose"),
        ("liability-disclaimer", "liable", "in no event shall (?:the )?(?:\\S+ ){1,8}be liable"),
    ):
        add(label, keyword, pattern, GRANT)

    # Licences that are only named.
    for label, keyword, pattern in (
        ("mit", "mit licen", "mit licen[sc]e"), ("mit", "expat", "expat licen[sc]e"),
        ("isc", "isc licen", "isc licen[sc]e"), ("x11", "x11", "x11 licen[sc]e"),
        ("bsd", "bsd", "bsd licen[sc]e"), ("bsd", "bsd", "bsd style licen[sc]e"),
        ("bsd-2-clause", "bsd", "(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[sc]e)?"),
        ("bsd-3-clause", "bsd", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd)(?: licen[sc]e)?"),
        ("bsd-4-clause", "bsd", "(?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?"),
        ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e"), ("wtfpl", "wtfpl", "wtfpl"),
        ("unlicense", "unlicense", "(?:the )?unlicense"), ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
        ("postgresql", "postgresql", "postgresql licen[sc]e"), ("ruby", "ruby", "ruby licen[sc]e"),
        ("vim", "vim", "vim licen[sc]e"), ("openssl", "openssl", "openssl licen[sc]e"),
        ("sleepycat", "sleepycat", "sleepycat licen[sc]e"), ("w3c", "w3c", "w3c software (?:notice and )?licen[sc]e"),
        ("gpl", "gpl", r"gplv?\d?"), ("lgpl", "lgpl", r"lgplv?\d?"), ("agpl", "agpl", r"agplv?\d?"),
        ("public-domain", "public domain", "(?:in(?:to)? the )?public domain"),
        ("pddl", "pddl", "pddl"), ("fair", "fair licen", "fair licen[sc]e"),
        ("beerware", "beer", "beer ?ware licen[sc]e"), ("json", "json licen", "json licen[sc]e"),
        ("curl", "curl licen", "curl licen[sc]e"), ("libpng", "libpng", "libpng licen[sc]e"),
    ):
        add(label, keyword, pattern, NAMED - 10)

    # Notices that reserve rights.
    for label, keyword, pattern in (
        ("copyright", "copyright", r"copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)?"),
        ("copyright", "copyright", r"c copyright (?:19|20)\d\d"),
        ("reserved", "rights reserved", "all rights reserved worldwide"),
        ("some-rights", "rights reserved", "some rights reserved"),
        ("no-rights", "rights reserved", "no rights reserved"),
        ("proprietary", "proprietary", "(?:confidential and )?proprietary(?: and confidential)?"),
        ("proprietary", "unauthorized", "unauthorized (?:copying|use|reproduction|distribution)"),
        ("no-reproduction", "reproduced", "no part of this (?:\\S+ ){1,4}may be reproduced"),
        ("no-redistribution", "permission", "without (?:the )?(?:prior )?(?:express )?written permission"),
        ("non-commercial", "commercial", "(?:for )?non ?commercial use only"),
        ("evaluation", "evaluation", "for evaluation (?:purposes )?only"),
        ("trade-secret", "trade secret", "trade secrets?"),
        ("terms-of-use", "terms of", "terms of (?:use|service)"),
        ("end-user", "end user", "end user licen[sc]e agreement"),
    ):
        add(label, keyword, pattern, NOTICE)
    return out


RULES = _rules()
