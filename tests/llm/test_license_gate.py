"""The keyword gate of the license rules against trying all rules."""

import random
import re

import pytest

from kinlink.llm import licenses


def expand(parsed, r):
    """A random text that a parsed pattern matches."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, one = r.choice(arg)
            out += chr(one if str(kind) == "LITERAL" else r.randint(*one))
        elif name == "ANY":
            out += r.choice("ab ")
        elif name == "BRANCH":
            out += expand(r.choice(arg[1]), r)
        elif name == "SUBPATTERN":
            out += expand(arg[3], r)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += "".join(expand(arg[2], r) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 20))))
        elif name == "FAILURE":
            out += "\0"
        else:
            assert name == "ASSERT_NOT"
    return out


def test_gate_skips_no_match():
    r = random.Random(2)
    for label, _, _, pattern in licenses.rules()[1]:
        for _ in range(12):
            text = expand(re._parser.parse(pattern.pattern), r)
            words = text.encode().split()
            if pattern.fullmatch(b" ".join(words).decode()):
                assert licenses.scan(words) == licenses.scan(words, gate=False) != []


@pytest.mark.parametrize(("text", "label"), [("under the gplv3", "gpl"), ("lgplv2 1", "lgpl"), ("agplv3", "agpl"), ("gnu library general public license", "lgpl"), ("server side public license", "sspl"), ("open database license", "odbl"), ("european union public license", "eupl")])
def test_names_without_keyword(text, label):
    assert {m[2] for m in licenses.scan(text.encode().split())} == {label}


def slow_scan(words):
    """By the definition: every rule at every word, then matches by priority and length that lie in no match taken before."""
    line, found = b" ".join(words).decode(), []
    starts = [0, *(m.end() for m in re.finditer(" ", line))]
    for label, priority, confidence, pattern in licenses.rules()[1]:
        until = 0
        for at in starts:
            m = pattern.match(line, at) if at >= until else None
            if m:
                until, part = m.end(), min(pattern.groups, 1)
                found.append((-priority, m.start(part) - m.end(part), m.start(part), m.end(part), label, confidence))
    taken = []
    for f in sorted(found):
        if not any(a <= f[2] and f[3] <= b for _, _, a, b, _, _ in taken):
            taken.append(f)
    return sorted((line.count(" ", 0, a), line.count(" ", 0, b) + 1, label, -p, c) for p, _, a, b, label, c in taken)


def test_against_a_slow_matcher():
    r = random.Random(4)
    parsed = [re._parser.parse(x[3].pattern) for x in licenses.rules()[1]]
    for _ in range(60):
        text = " ".join(expand(r.choice(parsed), r).replace("\0", "") + r.choice((" and", "", " the work 2 0", " or mit")) for _ in range(4))
        words = text.encode().split()
        assert licenses.scan(words) == slow_scan(words)


CASES = [
    ("// SPDX-License-Identifier: MIT", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "apache,mit"), ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "gpl"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by-sa"), ("Licensed under GPLv3.", "gpl"), ("released under the LGPLv2.1+ licence", "lgpl"), ("under the AGPLv3", "agpl"), ("license: MIT", "mit"), ('"license": "Apache-2.0",', "apache"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "bsd"),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3-clause"),
    ("see http://www.apache.org/licenses/LICENSE-2.0 for it", "apache"), ("https://www.gnu.org/licenses/gpl-3.0.html", "gpl"), ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa"), ("https://opensource.org/licenses/MIT", "mit"),
    ("You should have received a copy of the GNU Lesser General Public License", "lgpl"), ("This is free and unencumbered software released into the public domain.", "unlicense"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"),
    ("License :: OSI Approved :: MIT License", "mit"), ("the mit campus has a licensed bar", ""), ("general licence to the public", ""), ("isc2 and gpl4 are no names of ours", ""), ("a letter of apache", ""),
]


@pytest.mark.parametrize(("text", "labels"), CASES)
def test_known_texts(text, labels):
    words = re.findall("[a-z0-9]+", text.lower())
    assert ",".join(sorted({m[2] for m in licenses.scan([w.encode() for w in words])})) == labels


def test_many_places_take_linear_time():
    words = b"mit license ".split() * 200_000
    assert len(licenses.base(words)) == 200_000
