"""Every signature rule: its keywords are in each of its matches, and the scan finds what it describes."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mudline.llm import license_rules, license_scan

RULES = license_rules.build_rules()


def wordings(rule):
    """Texts that a rule matches: from its expression without the spaces around it."""
    shape = rule.pattern.pattern.removeprefix("(?<= )").removesuffix("(?= )").replace("\\w", "[a-z]")
    return st.from_regex(shape, fullmatch=True)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_keywords_are_in_every_match(data):
    rule = data.draw(st.sampled_from(RULES))
    text = data.draw(wordings(rule))
    assert set(rule.keywords) & set(text.split()), (rule.label, text)


def test_each_rule_is_found_by_the_scan():
    """One wording of each rule gives its label, or one of an earlier rule that holds it."""
    seen = {i for i, rule in enumerate(RULES) if found_by_scan(i, rule)}
    assert len(seen) == len(RULES) > 300


def found_by_scan(place, rule):
    @settings(max_examples=3, deadline=None, database=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(wordings(rule))
    def check(text):
        _, found = license_scan.scan(f"Zebra {text.upper()} zebra.")
        kinds = {(m["label"], m["rule"]) for m in found if m["rule"] != "base"}
        first = min(i for i, r in enumerate(RULES) if (r.label, r.phrasing) in kinds)
        assert first <= place or any(label == rule.label for label, _ in kinds)

    check()
    return True


def test_license_texts():
    cases = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": {"mit"},
        "Released under the Expat license": {"mit"}, "GPLv3": {"gpl-3"}, "see the ASL 2.0": {"apache-2"}, "zero clause BSD license": {"0bsd"}, "CC BY 4.0": {"cc-by"}, "LGPL v3": {"lgpl-3"},
        "https://creativecommons.org/licenses/by-nc-sa/4.0/": {"cc-by-nc-sa"}, "This file is in the public domain": {"public-domain"}, "plain prose about permits and copies": set(),
        "http://www.apache.org/licenses/LICENSE-2.0": {"apache-2"}, "(c) 2020 Someone. All rights reserved.": {"all-rights-reserved"}, "MPL 2.0": {"mpl-2"},
    }
    for text, labels in cases.items():
        assert {m["label"] for m in license_scan.scan(text)[1]} == labels, text
