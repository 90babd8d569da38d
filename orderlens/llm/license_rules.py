"""Signature rules for licences, written by hand over lower-case words with one space between.

Every rule starts with a plain word.  Rules are ordered: a lower ``priority`` wins where
detections lie inside each other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Priorities: the licence's own words or a machine-readable tag, a grant, a full name or address, a mention.
TEXT, GRANT, NAME, MENTION = range(4)
WEIGHTS = {TEXT: 1.0, GRANT: 0.9, NAME: 0.75, MENTION: 0.5}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    pattern: str
    base: bool = False

    def _fixed(self) -> list[str]:
        """Words that stand in every match; the first word is always one of them."""
        flat = self.pattern
        while "(" in flat:
            flat = re.sub(r"\s*\([^()]*\)(\?|\{\d+,\d+\})?", " _", flat)
        words = flat.split()
        sure = [w for w, after in zip(words, [*words[1:], ""], strict=True) if _PLAIN.fullmatch(w) and not after.startswith("?")]
        return [words[0], *sure]

    @property
    def keywords(self) -> list[str]:
        """A text without one of these holds no match: the longest fixed word, in all its spellings."""
        return _spellings(max(self._fixed(), key=len))

    @property
    def starts(self) -> list[str]:
        """How a match begins: its first two words, or its first word where the second may differ."""
        words = self.pattern.split(" ")
        first = words[0].split("(")[0]
        if not first.isalnum():
            raise ValueError(f"a rule starts with a plain word: {self.pattern}")
        two = first == words[0] and len(words) > 1 and _PLAIN.fullmatch(words[1])
        if two and not (len(words) > 2 and words[2].startswith("?")):
            return [f"{first} {w}" for w in _spellings(words[1])]
        return [first]

    @property
    def weight(self) -> float:
        return WEIGHTS[self.priority]


#: A word without alternatives, but for the two spellings of licence.
_PLAIN = re.compile(r"(?:[a-z0-9]|\[sc\])+")


def _spellings(word: str) -> list[str]:
    return [word.replace("[sc]", c) for c in "sc"] if "[sc]" in word else [word]


#: Fixed values of the base: phrase and label.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

_ONLY = "( only| or later| or any later version)?"

#: Label, the words of its identifier, and its names; each name starts with a plain word.
FAMILIES: list[tuple[str, str, list[str]]] = [
    ("mit", "mit", ["mit licen[sc]e", "mit x11 licen[sc]e", "expat licen[sc]e", "mit expat licen[sc]e"]),
    ("mit-0", "mit 0", ["mit no attribution( licen[sc]e)?", "mit 0( licen[sc]e)?"]),
    ("x11", "x11", ["x11 licen[sc]e", "x consortium licen[sc]e"]),
    ("isc", "isc", ["isc licen[sc]e", "internet systems consortium licen[sc]e"]),
    ("apache-1.1", "apache 1 1", [r"apache( software)? licen[sc]e( version| v)? 1 1"]),
    ("apache-2.0", "apache 2 0", [r"apache( software)? licen[sc]e( version| v)? ?v?2( 0)?", r"apache v?2 0( licen[sc]e)?", "apache2( licen[sc]e)?", "asl 2 0", "apache licen[sc]e second edition"]),
    ("bsd-2-clause", "bsd 2 clause", ["bsd 2 clause( licen[sc]e)?", "simplified bsd( licen[sc]e)?", "freebsd licen[sc]e", "two clause bsd( licen[sc]e)?"]),
    ("bsd-3-clause", "bsd 3 clause", ["bsd 3 clause( licen[sc]e)?", "new bsd licen[sc]e", "modified bsd licen[sc]e", "revised bsd licen[sc]e", "three clause bsd( licen[sc]e)?"]),
    ("bsd-4-clause", "bsd 4 clause", ["bsd 4 clause( licen[sc]e)?", "original bsd licen[sc]e", "four clause bsd( licen[sc]e)?"]),
    ("0bsd", "0bsd", ["zero clause bsd( licen[sc]e)?", "bsd zero clause( licen[sc]e)?", "0bsd licen[sc]e"]),
    ("gpl-1.0", "gpl 1 0", [rf"gnu general public licen[sc]e( version| v)? ?v?1( 0)?{_ONLY}", "gpl v?1( 0)?( only| or later)?", "gplv1"]),
    ("gpl-2.0", "gpl 2 0", [rf"gnu general public licen[sc]e( version| v)? ?v?2( 0)?{_ONLY}", "gnu gpl( version| v)? ?v?2( 0)?", "gpl( version| v)? ?v?2( 0)?( only| or later)?", "gplv2( only| or later)?"]),
    ("gpl-3.0", "gpl 3 0", [rf"gnu general public licen[sc]e( version| v)? ?v?3( 0)?{_ONLY}", "gnu gpl( version| v)? ?v?3( 0)?", "gpl( version| v)? ?v?3( 0)?( only| or later)?", "gplv3( only| or later)?"]),
    ("lgpl-2.0", "lgpl 2 0", [rf"gnu library general public licen[sc]e( version| v)? ?v?2( 0)?{_ONLY}", "lgpl( version| v)? ?v?2 0( only| or later)?"]),
    ("lgpl-2.1", "lgpl 2 1", [rf"gnu lesser general public licen[sc]e( version| v)? ?v?2 1{_ONLY}", "gnu lgpl( version| v)? ?v?2 1", "lgpl( version| v)? ?v?2 1( only| or later)?", "lgplv2( 1)?"]),
    ("lgpl-3.0", "lgpl 3 0", [rf"gnu lesser general public licen[sc]e( version| v)? ?v?3( 0)?{_ONLY}", "gnu lgpl( version| v)? ?v?3( 0)?", "lgpl( version| v)? ?v?3( 0)?( only| or later)?", "lgplv3"]),
    ("agpl-3.0", "agpl 3 0", [rf"gnu affero general public licen[sc]e(( version| v)? ?v?3( 0)?)?{_ONLY}", "affero general public licen[sc]e", "agpl( version| v)? ?v?3( 0)?( only| or later)?", "agplv3"]),
    ("gfdl-1.2", "gfdl 1 2", ["gnu free documentation licen[sc]e( version| v)? ?v?1 2", "gfdl 1 2"]),
    ("gfdl-1.3", "gfdl 1 3", ["gnu free documentation licen[sc]e( version| v)? ?v?1 3", "gfdl 1 3"]),
    ("mpl-1.1", "mpl 1 1", ["mozilla public licen[sc]e( version| v)? ?v?1 1", "mpl( version| v)? ?v?1 1"]),
    ("mpl-2.0", "mpl 2 0", ["mozilla public licen[sc]e( version| v)? ?v?2( 0)?", "mpl( version| v)? ?v?2 0"]),
    ("epl-1.0", "epl 1 0", ["eclipse public licen[sc]e( version| v)? ?v?1( 0)?", "epl( version| v)? ?v?1 0"]),
    ("epl-2.0", "epl 2 0", ["eclipse public licen[sc]e( version| v)? ?v?2( 0)?", "epl( version| v)? ?v?2 0"]),
    ("cddl-1.0", "cddl 1 0", ["common development and distribution licen[sc]e( version| v)? ?v?1( 0)?", "cddl( version| v)? ?v?1 0"]),
    ("cddl-1.1", "cddl 1 1", ["common development and distribution licen[sc]e( version| v)? ?v?1 1", "cddl( version| v)? ?v?1 1"]),
    ("cpl-1.0", "cpl 1 0", ["common public licen[sc]e( version| v)?( 1 0)?"]),
    ("ipl-1.0", "ipl 1 0", ["ibm public licen[sc]e( version| v)?( 1 0)?"]),
    ("eupl-1.1", "eupl 1 1", ["european union public licen[sc]e( version| v)? ?v?1 1", "eupl( version| v)? ?v?1 1"]),
    ("eupl-1.2", "eupl 1 2", ["european union public licen[sc]e( version| v)? ?v?1 2", "eupl( version| v)? ?v?1 2"]),
    ("artistic-1.0", "artistic 1 0", ["artistic licen[sc]e( version| v)? ?v?1( 0)?"]),
    ("artistic-2.0", "artistic 2 0", ["artistic licen[sc]e( version| v)? ?v?2( 0)?"]),
    ("zlib", "zlib", ["zlib licen[sc]e", "zlib libpng licen[sc]e"]),
    ("libpng", "libpng", ["libpng licen[sc]e"]),
    ("bsl-1.0", "bsl 1 0", ["boost software licen[sc]e( version| v)?( 1 0)?"]),
    ("unlicense", "unlicense", ["unlicense"]),
    ("wtfpl", "wtfpl", ["wtfpl( licen[sc]e)?", "fuck you want to public licen[sc]e"]),
    ("psf-2.0", "psf 2 0", ["python software foundation licen[sc]e( version| v)?( 2)?", "psf licen[sc]e( agreement)?"]),
    ("php-3.01", "php 3 01", ["php licen[sc]e( version| v)?( 3 01)?"]),
    ("ruby", "ruby", ["ruby licen[sc]e"]),
    ("openssl", "openssl", ["openssl licen[sc]e"]),
    ("curl", "curl", ["curl licen[sc]e"]),
    ("ncsa", "ncsa", ["university of illinois ncsa open source licen[sc]e", "ncsa( open source)? licen[sc]e"]),
    ("ms-pl", "ms pl", ["microsoft public licen[sc]e", "ms pl licen[sc]e"]),
    ("ms-rl", "ms rl", ["microsoft reciprocal licen[sc]e"]),
    ("ofl-1.1", "ofl 1 1", ["sil open font licen[sc]e( version| v)?( 1 1)?", "open font licen[sc]e( version| v)?( 1 1)?"]),
    ("osl-3.0", "osl 3 0", ["open software licen[sc]e( version| v)?( 3 0)?"]),
    ("afl-3.0", "afl 3 0", ["academic free licen[sc]e( version| v)?( 3 0)?"]),
    ("upl-1.0", "upl 1 0", ["universal permissive licen[sc]e( version| v)?( 1 0)?"]),
    ("postgresql", "postgresql", ["postgresql licen[sc]e"]),
    ("busl-1.1", "busl 1 1", ["business source licen[sc]e( version| v)?( 1 1)?"]),
    ("sspl-1.0", "sspl 1 0", ["server side public licen[sc]e( version| v)?( 1)?", "sspl( version| v)? ?v?1( 0)?"]),
    ("elastic-2.0", "elastic 2 0", ["elastic licen[sc]e( version| v)?( 2 0)?"]),
    ("polyform-noncommercial", "polyform noncommercial 1 0 0", ["polyform noncommercial licen[sc]e"]),
    ("cc0-1.0", "cc0 1 0", ["cc0( 1 0)?( universal)?", "creative commons zero( licen[sc]e)?", "creative commons cc0"]),
    ("cc-by-sa-3.0", "cc by sa 3 0", ["cc by sa 3 0", "creative commons attribution share ?alike 3 0"]),
    ("cc-by-sa-4.0", "cc by sa 4 0", ["cc by sa 4 0", "creative commons attribution share ?alike 4 0"]),
    ("cc-by-nc-3.0", "cc by nc 3 0", ["cc by nc 3 0", "creative commons attribution non ?commercial 3 0"]),
    ("cc-by-nc-4.0", "cc by nc 4 0", ["cc by nc 4 0", "creative commons attribution non ?commercial 4 0"]),
    ("cc-by-nd-4.0", "cc by nd 4 0", ["cc by nd 4 0", "creative commons attribution no ?deriv(ative)?s 4 0"]),
    ("cc-by-nc-sa-4.0", "cc by nc sa 4 0", ["cc by nc sa 4 0", "creative commons attribution non ?commercial share ?alike 4 0"]),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0", ["cc by nc nd 4 0", "creative commons attribution non ?commercial no ?deriv(ative)?s 4 0"]),
    ("cc-by-2.0", "cc by 2 0", ["cc by 2 0", "creative commons attribution 2 0"]),
    ("cc-by-2.5", "cc by 2 5", ["cc by 2 5", "creative commons attribution 2 5"]),
    ("cc-by-3.0", "cc by 3 0", ["cc by 3 0", "creative commons attribution 3 0"]),
    ("cc-by-4.0", "cc by 4 0", ["cc by 4 0", "creative commons attribution 4 0( international)?"]),
    ("odbl-1.0", "odbl 1 0", ["open database licen[sc]e( version| v)?( 1 0)?", "odbl( 1 0)?"]),
    ("odc-by-1.0", "odc by 1 0", ["open data commons attribution licen[sc]e", "odc by( 1 0)?"]),
    ("pddl-1.0", "pddl 1 0", ["public domain dedication and licen[sc]e", "pddl( 1 0)?"]),
]

#: Families without a version: they name less, and lose to a longer name.
_FAMILY_NAMES: list[tuple[str, str]] = [
    ("gpl", "gnu general public licen[sc]e"),
    ("gpl", "gnu gpl"),
    ("gpl", "gpl( licen[sc]e)?"),
    ("gpl", "general public licen[sc]e"),
    ("lgpl", "gnu (lesser|library) general public licen[sc]e"),
    ("lgpl", "lgpl( licen[sc]e)?"),
    ("agpl", "agpl( licen[sc]e)?"),
    ("gfdl", "gnu free documentation licen[sc]e"),
    ("apache", "apache( software)? licen[sc]e"),
    ("bsd", "bsd( style)? licen[sc]e"),
    ("mpl", "mozilla public licen[sc]e"),
    ("epl", "eclipse public licen[sc]e"),
    ("cddl", "common development and distribution licen[sc]e"),
    ("eupl", "european union public licen[sc]e"),
    ("artistic", "artistic licen[sc]e"),
    ("cc-by", "cc by"),
    ("cc-by", "creative commons attribution( licen[sc]e)?"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-sa", "creative commons attribution share ?alike( licen[sc]e)?"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nc", "creative commons attribution non ?commercial( licen[sc]e)?"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-nc-sa", "cc by nc sa"),
    ("cc-by-nc-nd", "cc by nc nd"),
    ("creative-commons", "creative commons( licen[sc]e)?"),
    ("public-domain", "public domain( dedication)?"),
    ("proprietary", "all rights reserved"),
    ("proprietary", "proprietary (and confidential|licen[sc]e|software)"),
    ("proprietary", "commercial licen[sc]e( agreement)?"),
    ("copyright", "copyright (c )?(19|20)[0-9][0-9]"),
    ("copyright", "copyright (c|by|holder|holders|owner|owners)"),
]

#: The licences' own words.
_TEXTS: list[tuple[str, str]] = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("bsd", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither the name( of)?( the)?( [^ ]+){1,8} nor the names of (its|any|the) contributors"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledg(e)?ment"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "licensed to the apache software foundation( asf)? under one or more contributor license agreements"),
    ("gpl", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    ("agpl", "free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "you should have received a copy of the gnu lesser general public license"),
    ("agpl", "you should have received a copy of the gnu affero general public license"),
    ("gpl-2.0", "either version 2 of the license or (at your option )?any later version"),
    ("gpl-3.0", "either version 3 of the license or (at your option )?any later version"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "source code form is subject to the terms of the mozilla public license( v| version)? 2 0"),
    ("mpl-1.1", "contents of this file are subject to the mozilla public license( v| version)? 1 1"),
    ("cddl-1.0", "contents of this file are subject to the terms of the common development and distribution license"),
    ("epl", "accompanying materials are made available under the terms of the eclipse public license"),
    ("zlib", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("unlicense", "free and unencumbered software released into the public domain"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("ofl-1.1", "font software is licensed under the sil open font license version 1 1"),
    ("cc0-1.0", "waived all copyright and related or neighboring rights"),
    ("cc-by-sa-4.0", "creative commons attribution share ?alike 4 0 international( public)? license"),
    ("cc-by-4.0", "creative commons attribution 4 0 international( public)? license"),
    ("ms-pl", "accept the license if you do not accept the license do not use the software"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("proprietary", "unauthorized (copying|use|reproduction|distribution)( [^ ]+){1,12} is strictly prohibited"),
    ("proprietary", "may not be (reproduced|copied|redistributed)( [^ ]+){0,12} without( the)?( express)?( prior)? written (permission|consent)"),
    ("public-domain", "dedicated to the public domain"),
    ("public-domain", "released into the public domain"),
    ("public-domain", "placed in the public domain"),
]

#: Addresses of licence texts; slashes and dots are gaps between words.
_ADDRESSES: list[tuple[str, str]] = [
    ("apache-2.0", "apache org licenses license 2 0"),
    ("mit", "opensource org licenses mit"),
    ("bsd-2-clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause"),
    ("isc", "opensource org licenses isc"),
    ("gpl-2.0", "gnu org licenses( old licenses)? gpl 2 0"),
    ("gpl-3.0", "gnu org licenses gpl 3 0"),
    ("gpl", "gnu org licenses gpl"),
    ("gpl", "gnu org copyleft gpl"),
    ("lgpl-2.1", "gnu org licenses( old licenses)? lgpl 2 1"),
    ("lgpl-3.0", "gnu org licenses lgpl 3 0"),
    ("agpl-3.0", "gnu org licenses agpl( 3 0)?"),
    ("gpl", "gnu org licenses"),
    ("mpl-2.0", "mozilla org( en us)? mpl 2 0"),
    ("epl-2.0", "eclipse org legal epl 2 0"),
    ("epl-1.0", "eclipse org legal epl v10"),
    ("unlicense", "unlicense org"),
    ("bsl-1.0", "boost org license 1 0"),
    ("ofl-1.1", "scripts sil org ofl"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", "creativecommons org publicdomain mark 1 0"),
    ("cc-by-sa-3.0", "creativecommons org licenses by sa 3 0"),
    ("cc-by-sa-4.0", "creativecommons org licenses by sa 4 0"),
    ("cc-by-nc-4.0", "creativecommons org licenses by nc 4 0"),
    ("cc-by-nd-4.0", "creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-sa-4.0", "creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4.0", "creativecommons org licenses by nc nd 4 0"),
    ("cc-by-3.0", "creativecommons org licenses by 3 0"),
    ("cc-by-4.0", "creativecommons org licenses by 4 0"),
    ("creative-commons", "creativecommons org licenses( [a-z]+){1,3}( [0-9]){0,2}"),
]

#: How a text says that it is under a licence; each starts with a plain word.
_GRANTS = [
    "licensed under( the terms of)?( the| a| an)? {}",
    "released under( the terms of)?( the| a| an)? {}",
    "distributed under( the terms of)?( the| a| an)? {}",
    "available under( the terms of)?( the| a| an)? {}",
    "published under( the terms of)?( the| a| an)? {}",
]


def _rules() -> list[Rule]:
    rules = [Rule(label, MENTION, phrase, True) for phrase, label in BASE]
    rules += [Rule(label, TEXT, p) for label, p in _TEXTS]
    for label, words, names in FAMILIES:
        rules.append(Rule(label, TEXT, f"spdx license identifier {words}{_ONLY}"))
        rules.append(Rule(label, GRANT, f"license( expression| id| name| type)? {words}{_ONLY}"))
        either = "|".join(names)
        rules += [Rule(label, GRANT, g.format(f"({either})")) for g in _GRANTS]
        rules += [Rule(label, NAME, n) for n in names]
    rules += [Rule(label, NAME, p) for label, p in _ADDRESSES]
    for label, name in _FAMILY_NAMES:
        rules.append(Rule(label, MENTION, name))
    families = {}
    for label, name in _FAMILY_NAMES:
        if label not in ("copyright", "proprietary"):
            families.setdefault(label, []).append(name)
    for label, names in families.items():
        rules += [Rule(label, GRANT, g.format(f"({'|'.join(names)})")) for g in _GRANTS]
    return rules


RULES = _rules()
