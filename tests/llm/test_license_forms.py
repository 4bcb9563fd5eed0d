"""Every alternative of every license name gets past the keywords; short forms, headers and bodies have rules."""

from __future__ import annotations

import itertools
from re import _parser

import pytest

from mudline.llm import license_rules, license_scan


def variants(parsed) -> list[str]:
    """Texts of an expression: each branch and each class, with and without optional parts."""
    out = [""]
    for kind, arg in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            got = [chr(arg)]
        elif kind == "IN":
            got = [chr(c) for k, v in arg for c in (range(v[0], v[1] + 1) if str(k) == "RANGE" else [v])][:2]
        elif kind == "BRANCH":
            got = [v for b in arg[1] for v in variants(b)]
        elif kind == "SUBPATTERN":
            got = variants(arg[3])
        else:
            got = ["", *variants(arg[2])]
            assert kind == "MAX_REPEAT" and arg[:2] == (0, 1)
        out = [a + b for a, b in itertools.product(out, got)]
    return out


def test_every_alternative_fires():
    machine, rules = license_scan.compiled()
    for place, rule in enumerate(rules):
        if rule.phrasing != "name":
            continue
        name = rule.pattern.pattern.removeprefix("(?<= )").removesuffix("(?= )")
        for text in variants(_parser.parse(name)):
            assert rule.pattern.search(f" {text} "), text
            assert any(place in places for _, places in machine.iter(f" {text} ")), text
            assert license_scan.scan(text)[1], text


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Released under the Expat license", "mit"), ("GPLv3", "gpl-3"), ("gplv2", "gpl-2"), ("ASL 2.0", "apache-2"), ("zero clause BSD license", "0bsd"), ("CC BY 4.0", "cc-by"), ("LGPL 2.1", "lgpl-2.1"), ("AGPLv3", "agpl-3"), ("MPL 2.0", "mpl-2"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"), ("Redistribution and use in source and binary forms", "bsd"),
        ("the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gpl-2"),
    ],
)
def test_forms(text, label):
    assert label in {m["label"] for m in license_scan.scan(text)[1]}
