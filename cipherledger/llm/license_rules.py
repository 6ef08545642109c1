"""Signature rules of licences: hand-written patterns over words, in families of decreasing priority.

``license_signatures`` has those of texts, notices, metadata and dual licences; here are names, identifiers and addresses.
A pattern reads a text's words in lower case with one blank between them. ``V(n)`` is a version as it is usually written.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from cipherledger.llm.license_signatures import KINDS, SIGNATURES


class Rule(NamedTuple):
    """``gates``: every match contains one of these strings; ``priority``: the higher one wins an overlap."""

    name: str
    label: str
    gates: tuple[bytes, ...]
    pattern: re.Pattern[bytes]
    priority: int
    weight: float


def V(major: str, minor: str = "0") -> str:
    return rf"(?: version| v)? v?{major}(?: {minor})?"


#: Phrases that always count, with their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: label: (strings, separated by |, of which every name holds one; name, identifier as words, address as words or nothing)
LICENSES = {
    "mit": ("mit", r"mit (?:x11 )?licen[sc]e|expat licen[sc]e mit", "mit", "opensource org licenses mit"),
    "apache-2": ("apache", rf"apache (?:software )?licen[sc]e{V('2')}", "apache 2 0", "apache org licenses license 2 0"),
    "apache-1.1": ("apache", rf"apache (?:software )?licen[sc]e{V('1', '1')}", "apache 1 1", ""),
    "gpl-2": ("general public", rf"gnu general public licen[sc]e{V('2')}", r"gpl 2 0(?: only| or later)?", "gnu org licenses gpl 2 0"),
    "gpl-3": ("general public", rf"gnu general public licen[sc]e{V('3')}", r"gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0"),
    "gpl": ("general public", r"gnu general public licen[sc]e", "gpl", "gnu org licenses gpl"),
    "lgpl-2.1": ("general public", rf"gnu lesser general public licen[sc]e{V('2', '1')}", r"lgpl 2 1(?: only| or later)?", "gnu org licenses lgpl 2 1"),
    "lgpl-3": ("general public", rf"gnu lesser general public licen[sc]e{V('3')}", r"lgpl 3 0(?: only| or later)?", "gnu org licenses lgpl 3 0"),
    "lgpl-2": ("general public", rf"gnu library general public licen[sc]e{V('2')}", r"lgpl 2 0(?: only| or later)?", ""),
    "lgpl": ("general public", r"gnu (?:lesser|library) general public licen[sc]e", "lgpl", "gnu org licenses lgpl"),
    "agpl-3": ("general public", rf"gnu affero general public licen[sc]e{V('3')}", r"agpl 3 0(?: only| or later)?", "gnu org licenses agpl"),
    "agpl-1": ("general public", rf"affero general public licen[sc]e{V('1')}", "agpl 1 0", ""),
    "gfdl-1.3": ("documentation", rf"gnu free documentation licen[sc]e{V('1', '3')}", "gfdl 1 3", "gnu org licenses fdl 1 3"),
    "gfdl": ("documentation", r"gnu free documentation licen[sc]e", "gfdl", "gnu org licenses fdl"),
    "bsd-2": ("bsd", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: licen[sc]e)?", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    "bsd-3": ("bsd", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    "bsd-4": ("bsd", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: licen[sc]e)?", "bsd 4 clause", ""),
    "bsd-0": ("bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[sc]e)?", "0bsd", "opensource org licenses 0bsd"),
    "bsd": ("bsd", r"bsd(?: style)? licen[sc]e", "bsd", ""),
    "isc": ("isc|systems consortium", r"isc licen[sc]e|internet systems consortium licen[sc]e", "isc", "opensource org licenses isc"),
    "mpl-1.1": ("mozilla", rf"mozilla public licen[sc]e{V('1', '1')}", "mpl 1 1", "mozilla org mpl mpl 1 1"),
    "mpl-2": ("mozilla", rf"mozilla public licen[sc]e{V('2')}", "mpl 2 0", "mozilla org mpl 2 0"),
    "mpl": ("mozilla", r"mozilla public licen[sc]e", "mpl", "mozilla org mpl"),
    "epl-1": ("eclipse", rf"eclipse public licen[sc]e{V('1')}", "epl 1 0", "eclipse org legal epl v10"),
    "epl-2": ("eclipse", rf"eclipse public licen[sc]e{V('2')}", "epl 2 0", "eclipse org legal epl 2 0"),
    "edl-1": ("eclipse", rf"eclipse distribution licen[sc]e{V('1')}", "edl 1 0", "eclipse org org documents edl v10"),
    "cddl-1": ("development and distribution", rf"common development and distribution licen[sc]e{V('1')}", "cddl 1 0", "opensource org licenses cddl"),
    "cpl-1": ("common public", rf"common public licen[sc]e{V('1')}", "cpl 1 0", ""),
    "ipl-1": ("ibm", rf"ibm public licen[sc]e{V('1')}", "ipl 1 0", ""),
    "eupl-1.2": ("european union", rf"european union public licen[sc]e{V('1', '2')}", "eupl 1 2", "joinup ec europa eu"),
    "eupl-1.1": ("european union", rf"european union public licen[sc]e{V('1', '1')}", "eupl 1 1", ""),
    "artistic-1": ("artistic", rf"(?:perl )?artistic licen[sc]e{V('1')}", "artistic 1 0", ""),
    "artistic-2": ("artistic", rf"(?:perl )?artistic licen[sc]e{V('2')}", "artistic 2 0", "opensource org licenses artistic 2 0"),
    "bsl-1": ("boost", r"boost software licen[sc]e(?: version)?(?: 1 0)?", "bsl 1 0", "boost org license 1 0"),
    "zlib": ("zlib", r"zlib(?: libpng)? licen[sc]e", "zlib", "opensource org licenses zlib"),
    "libpng": ("libpng", r"libpng licen[sc]e", "libpng", ""),
    "unlicense": ("unlicense", r"the unlicense", "unlicense", "unlicense org"),
    "wtfpl": ("public licen", r"do what the f\w+ you want to public licen[sc]e", "wtfpl", "wtfpl net"),
    "openssl": ("openssl", r"openssl licen[sc]e", "openssl", ""),
    "python-2": ("python", rf"python software foundation licen[sc]e(?:{V('2')})?", "python 2 0", "docs python org license"),
    "ruby": ("ruby", r"ruby licen[sc]e", "ruby", ""),
    "php-3": ("php", rf"php licen[sc]e{V('3', '01?')}", "php 3 01", "php net license 3 01"),
    "ncsa": ("illinois", r"university of illinois (?:ncsa )?open source licen[sc]e", "ncsa", ""),
    "postgresql": ("postgresql", r"postgresql licen[sc]e", "postgresql", "opensource org licenses postgresql"),
    "vim": ("vim", r"vim licen[sc]e", "vim", ""),
    "curl": ("curl", r"curl licen[sc]e", "curl", ""),
    "x11": ("x11", r"x11 licen[sc]e", "x11", ""),
    "w3c": ("w3c", r"w3c software (?:notice and )?licen[sc]e", "w3c", "w3 org consortium legal"),
    "afl-3": ("academic free", rf"academic free licen[sc]e{V('3')}", "afl 3 0", ""),
    "osl-3": ("open software licen", rf"open software licen[sc]e{V('3')}", "osl 3 0", ""),
    "ms-pl": ("microsoft public", r"microsoft public licen[sc]e", "ms pl", ""),
    "ms-rl": ("microsoft reciprocal", r"microsoft reciprocal licen[sc]e", "ms rl", ""),
    "upl-1": ("universal permissive", rf"universal permissive licen[sc]e(?:{V('1')})?", "upl 1 0", ""),
    "ofl-1.1": ("open font", rf"sil open font licen[sc]e(?:{V('1', '1')})?", "ofl 1 1", "scripts sil org ofl"),
    "odbl-1": ("database", rf"open (?:data commons )?(?:open )?database licen[sc]e(?:{V('1')})?", "odbl 1 0", "opendatacommons org licenses odbl"),
    "pddl-1": ("public domain dedication", r"(?:open data commons )?public domain dedication and licen[sc]e", "pddl 1 0", "opendatacommons org licenses pddl"),
    "odc-by-1": ("open data commons", r"open data commons attribution licen[sc]e", "odc by 1 0", "opendatacommons org licenses by"),
    "sspl-1": ("server side", rf"server side public licen[sc]e(?:{V('1')})?", "sspl 1 0", ""),
    "busl-1.1": ("business source", rf"business source licen[sc]e(?:{V('1', '1')})?", "busl 1 1", ""),
    "elastic-2": ("elastic", rf"elastic licen[sc]e(?:{V('2')})?", "elastic 2 0", ""),
    "cc-by": ("creative commons", rf"creative commons attribution(?:{V('[1-4]', '[05]')})?(?: international| unported| generic)?(?: public)? licen[sc]e", r"cc by [1-4] [05]", "creativecommons org licenses by"),
    "cc-by-sa": ("share", rf"creative commons attribution share ?alike(?:{V('[1-4]', '[05]')})?", r"cc by sa(?: [1-4] [05])?", "creativecommons org licenses by sa"),
    "cc-by-nd": ("deriv", rf"creative commons attribution no ?derivs?(?:atives)?(?:{V('[1-4]', '[05]')})?", r"cc by nd(?: [1-4] [05])?", "creativecommons org licenses by nd"),
    "cc-by-nc": ("commercial", rf"creative commons attribution non ?commercial(?:{V('[1-4]', '[05]')})?", r"cc by nc(?: [1-4] [05])?", "creativecommons org licenses by nc"),
    "cc-by-nc-sa": ("commercial", rf"creative commons attribution non ?commercial share ?alike(?:{V('[1-4]', '[05]')})?", r"cc by nc sa(?: [1-4] [05])?", "creativecommons org licenses by nc sa"),
    "cc-by-nc-nd": ("commercial", rf"creative commons attribution non ?commercial no ?derivs?(?:atives)?(?:{V('[1-4]', '[05]')})?", r"cc by nc nd(?: [1-4] [05])?", "creativecommons org licenses by nc nd"),
    "cc0": ("cc0|commons zero", rf"(?:creative commons (?:zero|cc0)|cc0)(?:{V('1')})?(?: universal)?", r"cc0(?: 1 0)?", "creativecommons org publicdomain zero"),
}

#: label: (string in every match, words of the licence's own text)
CLAUSES = {
    "mit": ("free of charge", r"permission is hereby granted free of charge to any person obtaining a copy"),
    "isc": ("without fee", r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    "bsd": ("redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    "gpl": ("free software", r"this (?:program|library) is free software you can redistribute it and or modify it"),
    "zlib": ("as is", r"provided as is without any express or implied warranty in no event will the authors be held liable"),
    "unlicense": ("unencumbered", r"this is free and unencumbered software released into the public domain"),
    "bsl-1": ("person or organization", r"hereby granted free of charge to any person or organization obtaining a copy of the software"),
    "public-domain": ("public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    "all-rights-reserved": ("all rights reserved", r"all rights reserved"),
    "proprietary": ("confidential", r"(?:proprietary and confidential|confidential and proprietary)"),
}

GRANT = (
    r"(?:licen[sc]ed|released|distributed|published|available|provided|offered|shared|covered) "
    r"(?:to you )?(?:under|by|with) (?:the )?(?:terms of )?(?:the )?"
)


def _compiled(words: str) -> re.Pattern[bytes]:
    return re.compile(rf"(?<![^ ])(?:{words})(?![^ ])".encode())


def rules() -> list[Rule]:
    """All rules, in order of priority."""
    found = [Rule(f"base:{label}", label, (phrase.encode(),), _compiled(phrase), 100, 0.95) for phrase, label in BASE.items()]
    for label, (gate, name, short, address) in LICENSES.items():
        keys, first = tuple(gate.encode().split(b"|")), short.split(" ")[0].split("(")[0].encode()
        found.append(Rule(f"tag:{label}", label, (b"spdx",), _compiled(rf"spdx licen[sc]e identifier (?:{short})"), 90, 1.0))
        if address:
            found.append(Rule(f"address:{label}", label, (address.encode(),), _compiled(address), 80, 0.9))
        found.append(Rule(f"grant:{label}", label, keys, _compiled(rf"{GRANT}(?:{name})"), 70, 0.95))
        found.append(Rule(f"short:{label}", label, (first,), _compiled(rf"{GRANT}(?:{short})(?: licen[sc]e)?"), 60, 0.85))
        found.append(Rule(f"name:{label}", label, keys, _compiled(name), 50, 0.7))
    for label, (gate, words) in CLAUSES.items():
        found.append(Rule(f"clause:{label}", label, (gate.encode(),), _compiled(words), 40, 0.8))
    for name, label, gate, kind, words, _ in SIGNATURES:
        priority, weight = KINDS[kind]
        found.append(Rule(f"{kind}:{name}", label, (gate.encode(),), _compiled(words), priority, weight))
    return sorted(found, key=lambda r: -r.priority)
