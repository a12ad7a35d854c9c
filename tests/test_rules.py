import re

import pytest

from glintsieve.operators.packs import builtin_rules
from glintsieve.operators.report import rule_catalogue
from glintsieve.operators.rules import Rule, RuleError, RuleSet, load_rules, read_file, severity_rank
from glintsieve.operators.screen import mandatory_texts, prefix_tree_pattern, screen_pattern, texts_of


def test_builtin_rules():
    rules = load_rules()
    assert len(rules.rules) == 66 and len(rules.enabled) == 63
    assert [severity_rank(r.severity) for r in rules.rules] == sorted(severity_rank(r.severity) for r in rules.rules)
    assert RuleSet.from_mappings(rules.to_mappings()).to_mappings() == rules.to_mappings()


def test_selection():
    rules = load_rules()
    ids = lambda s: [r.id for r in s.rules]
    assert set(ids(rules.select(packs=["azure"]))) == {r.id for r in builtin_rules() if r.pack == "azure"}
    assert ids(rules.select(include=["generic-hex-*"])) == ["generic-hex-secret"] and rules.select(include=["generic-hex-*"]).rules[0].enabled
    assert all("llm" in r.tags for r in rules.select(include=["tag:llm"]).rules)
    assert len(rules.select(exclude=["pack:*"]).rules) == 0
    assert len(rules.select(enable_all=True).enabled) == 66 and len(rules.select(enable=["generic-hex-secret"]).enabled) == 64
    assert {r.severity for r in rules.select(min_severity="high").rules} == {"critical", "high"}
    raised = rules.with_min_entropy(9.0)
    assert all((r.gate.min_entropy == 9.0) == r.gate.enabled for r in raised.rules if r.gate.enabled)


FILE = """
version: 1
pack: own
defaults: {severity: low, entropy: {min_length: 3, min_entropy: 1.0}}
rules:
  - {id: my-rule, name: Mine, pattern: 'zz([a-z]+)', capture: 1, entropy: {min_entropy: 0.5}}
  - {id: aws-access-key-id, name: Other, pattern: 'x'}
"""


def test_files(tmp_path):
    (tmp_path / "a.yaml").write_text(FILE)
    rules = load_rules([tmp_path])
    mine = rules.get("my-rule")
    assert (mine.severity, mine.pack, mine.gate.min_length, mine.gate.min_entropy) == ("low", "own", 3, 0.5)
    assert rules.get("aws-access-key-id").name == "Other" and len(rules.rules) == 67
    assert len(load_rules([tmp_path / "a.yaml"], builtin=False).rules) == 2
    with pytest.raises(RuleError):
        load_rules([tmp_path / "none.yaml"])


BAD = [
    "version: 2\nrules: []", "rules: 5", "[1]", "{", "rules: [3]",
    "rules: [{id: A_b, name: x, pattern: x}]", "rules: [{id: a, name: x, pattern: '('}]", "rules: [{id: a, name: x, pattern: x, colour: red}]", "rules: [{id: a, pattern: x}]",
    "rules: [{id: a, name: x, pattern: x, severity: odd}]", "rules: [{id: a, name: x, pattern: x, entropy: {nope: 1}}]", "rules: [{id: a, name: x, pattern: x, examples: {match: ['{hex:0}']}}]", "rules: [{id: a, name: x, pattern: x, capture: true}]",
]


@pytest.mark.parametrize("text", BAD)
def test_bad_files(tmp_path, text):
    (tmp_path / "a.yaml").write_text(text)
    with pytest.raises(RuleError):
        read_file(tmp_path / "a.yaml")


def test_prefix_tree():
    words = ["akia", "asia", "a3t", "ghp_", "gho_", "x.y", "x"]
    tree = re.compile(prefix_tree_pattern(words))
    for text in ["akia", "..asia", "x.y", "nothing here", "gh", "ghq_", ""]:
        assert bool(tree.search(text)) == any(w in text for w in words)
    with pytest.raises(ValueError):
        prefix_tree_pattern([])


def test_mandatory_texts():
    assert mandatory_texts(r"\b(foo|bar)_[0-9]+baz\b") in (("baz",), ("bar", "foo"))
    assert mandatory_texts(r"[a-z]+") == () and mandatory_texts(r"(?:abc)?x") == () and mandatory_texts("(") == ()
    assert mandatory_texts(r"(?:token|secret)=([a-z]+)", True) == ("secret", "token")


def test_the_screen_lets_every_rule_through():
    samples = {"my": ("zzq([0-9]+)", "a zzq123")}
    for pattern, text in samples.values():
        rule = Rule("r", "r", pattern)
        assert texts_of(rule) and re.search(screen_pattern([rule]), text)
    assert screen_pattern([Rule("r", "r", "[a-z]+")]) is None
    assert screen_pattern([]) is None


def test_catalogue():
    pages = rule_catalogue(load_rules())
    assert len(pages) == 8 and pages["aws.md"].count("\n| ") == 8 and pages == rule_catalogue(load_rules())
