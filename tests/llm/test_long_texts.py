"""One long text without blanks or with nothing but marks takes a few seconds at most: time grows with its length."""

import time

import pytest

from loomgraph.llm import passages, pseudonyms, ruleset, search

M = 1_000_000
LONG = {
    "a word beside @": "@" + "x" * M + "@b.com",
    "dots": "." * M,
    "dots and blanks": ". " * (M // 2),
    "full stops": "今日は天気。" * (M // 6),
    "hex and an address": "0123456789abcdef" * (M // 16) + " a@b.com",
    "a long secret": "api_key=" + "aB3" * (M // 3),
    "new lines": "\n" * M,
    "single digits": "1 " * (M // 2),
    "cards and phones": "4111 1111 1111 1111 " * (M // 40) + "+1 (741) 555-3069 " * (M // 40),
}


@pytest.mark.parametrize("name", LONG)
def test_long_text(name):
    text = LONG[name]
    start = time.process_time()
    passages.units_of(text)
    passages.units_of(text, paragraphs=True)
    out, found = pseudonyms.pseudonymised(text, b"k" * 32)
    ruleset.statistics(text.encode())
    search.terms(text.encode())
    assert time.process_time() - start < 60  # some seconds on a free machine; minutes to hours by the square
    assert len(out) == len(text)
    if name == "hex and an address":
        assert [f[0] for f in found] == ["email"]
    if name == "a long secret":
        assert [f[0] for f in found] == ["secret"]


def test_addresses():
    got = lambda t: [t[s:e] for _, s, e, _ in pseudonyms.pseudonymised(t, b"k" * 32)[1]]
    assert got("a@b.co+x@y.org, x@y.com@z.org a@b@c.de") == ["a@b.co", "+x@y.org", "x@y.com", "b@c.de"]
    assert got("連" * 70 + "bob.b@x.org") == ["bob.b@x.org"]  # no name is longer than 64
    assert got("x" * 65 + "@x.org") == [] and got("x" * 64 + "@x.org") == ["x" * 64 + "@x.org"]
    assert got("a@" + "b" * 300 + ".com") == []


def test_long_secrets_are_undone():
    """Blocks of a long value are permuted each by itself; none stays."""
    value = "Ab9" * 200
    out = pseudonyms.pseudonymised("token: " + value, b"k" * 32)[0].split()[1]
    assert len(out) == len(value) and all(out[k : k + 128] != value[k : k + 128] for k in range(0, 600, 128))
