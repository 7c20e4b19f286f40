"""op3, op7 and op9 against plain versions of their rules."""

import random
import re

import pytest

from acreflow.llm import licenses, pii, secrets
from acreflow.llm.tagger import Tagger, encode


def plain_spans(text, kinds):
    """Leftmost matches of each kind's pattern, then its test."""
    return [(kind, m.start(), m.end()) for kind, pattern, ok in kinds for m in re.finditer(pattern, text) if ok(m)]


def luhn(d):
    total = 0
    for i, c in enumerate(d[::-1]):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(m):
    return re.sub(r"[^0-9]", "", m[0])


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(_digits(m)) <= 15),
)
SECRETS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
)


def noisy(seed, n=500):
    r = random.Random(seed)
    pieces = ["a.b@c.d", "x@y", "a@b.c@d.e", "@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+1", "+44 20 7946 0958 123456", " ", "\n", ".", "é", "-", "9" * 20,
              "AKIA", "AKIAABCDEFGHIJKL", "AKIAAKIA1234", "password=", "Token : '", "api_key", "APIKEY=\"", "secretſ=", "abcdef0123456789" * 2, "deadbeef", "12345678", "====", "x/y+z_12"]
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 14))) for _ in range(n)] + ["", "9" * 5000 + ".1.1.1", "a" * 20_000 + "@b.c"]


@pytest.mark.parametrize("seed", [1, 2])
def test_personal_base_forms(seed):
    for text in noisy(seed)[:-2]:
        assert sorted(pii.base_spans(text)) == sorted(plain_spans(text, PII)), text
    assert [k for k, _, _ in pii.base_spans("a" * 20_000 + "@b.c")] == ["email"]
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []


@pytest.mark.parametrize("seed", [3, 4])
def test_secret_base_forms(seed):
    for text in noisy(seed):
        base, added = secrets.scan_text(text)
        assert sorted(base) == sorted(plain_spans(text, SECRETS)), text
        assert [s[1] for s in base] == sorted(s[1] for s in base)


def test_gradients_agree_with_differences():
    import numpy as np

    t = Tagger(3, hidden=4, seed=1)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    x, y = np.stack([encode("ab 12@c")] * 2), np.array([[0, 0, 0, 1, 2, 2, 0], [0, 1, 2, 0, 0, 0, 0]])
    _, grads = t.gradients(x, y)
    for name, at in (("w", (1, 2)), ("b", (1,)), ("t", (1, 2)), ("u", (0, 1, 3)), ("u", (1, 2, 7)), ("x", (0, int(x[0, 0]), 2)), ("x", (1, int(x[0, 5]), 9))):
        own, step = t.p[name][at], 1e-5
        losses = []
        for d in (step, -step):
            t.p[name][at] = own + d
            losses.append(t.gradients(x, y)[0])
        t.p[name][at] = own
        assert abs((losses[0] - losses[1]) / (2 * step) - grads[name][at]) < 2e-3, name


def test_decoding_finds_the_best_path():
    import itertools

    import numpy as np

    t = Tagger(3, hidden=2)
    r = np.random.default_rng(0)
    t.p["t"] = r.normal(size=(3, 3)).astype(np.float32)
    e = r.normal(size=(4, 5, 3)).astype(np.float32)
    for i, path in enumerate(t.decode(e)):
        score = lambda p, i=i: sum(e[i, j, p[j]] for j in range(5)) + sum(t.p["t"][p[j - 1], p[j]] for j in range(1, 5))
        assert tuple(path) == max(itertools.product(range(3), repeat=5), key=score)


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


def test_tagger_on_held_out_examples(tagger):
    texts, spans = pii.examples(400, 77)
    hit = wrong = missed = 0
    for text, want in zip(texts, spans, strict=True):
        want = {(k, a, b) for k, a, b in want if a > 0 and b < len(text)}
        x = encode(text)[None, :]
        got = {(pii.KINDS[k], a, b) for k, a, b in pii._spans_of(tagger.decode(tagger.emissions(x))[0]) if a > 0 and b < len(text)}
        hit, wrong, missed = hit + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert hit / (hit + wrong) > 0.8 and hit / (hit + missed) > 0.75


def test_added_spans_are_clear_of_base_ones_and_of_clean_texts(tagger):
    veiled = "Write to jane.doe [at] mail.example.com about it, or call (988) 555-2485 after noon; plain words follow for a while here."
    clean = ["The year 2021 had 365 days and 12.5 % rain, v1.2.3 came on 2024-01-02.", "### nothing $$$ here &&&", "plain prose without any cue at all " * 30]
    base = [pii.base_spans(x) for x in (veiled, *clean)]
    added = pii.added_spans(tagger, [veiled, *clean], base)
    assert {k for k, _, _ in added[0]} >= {"phone"} and added[1:] == [[], [], []]
    text = "a.b@c.example.com " * 40
    assert pii.added_spans(tagger, [text], [pii.base_spans(text)]) == [[]]


class ByClass(Tagger):
    """Tags letters, digits and some marks by what they are: everything but blanks and low lines is in a span."""

    def __init__(self, kind):
        super().__init__(1 + 2 * len(pii.KINDS))
        self.kind = pii.KINDS.index(kind)

    def emissions(self, x):
        import numpy as np

        e = np.zeros((*x.shape, self.tags), np.float32)
        e[..., 2 + 2 * self.kind] = np.where((x == 0) | np.isin(x, encode(" _")), -1.0, 1.0)
        return e


@pytest.mark.parametrize("kind, form", [
    ("ip", "2001:0db8:85a3:1234:5678:8a2e:0370:7334"),
    ("email", "maximiliane.von.hohenstein(at)post.rechenzentrum.example.com"),
    ("email", "a" * 300 + "(at)" + "b" * 900 + ".example.com"),
])
def test_added_spans_of_any_length_at_any_place(kind, form):
    tagger = ByClass(kind)
    for at in range(500, 500 + 2 * pii.WINDOW):
        text = "_ " * (at // 2) + " " * (at % 2) + form + " _" * 500
        assert pii.added_spans(tagger, [text, "_", form], [[], [], []]) == [[(kind, at, at + len(form))], [], [(kind, 0, len(form))]]


def test_long_runs_decode_as_short_ones():
    import numpy as np

    t, r = Tagger(5, hidden=2), np.random.default_rng(3)
    t.p["t"] = r.normal(size=(5, 5)).astype(np.float32)
    for n in (2, 64, 65, 66, 128, 129, 300, 641):
        e = r.normal(size=(n, 5)).astype(np.float32)
        assert t.decode_long(e).tolist() == t.decode(e[None])[0].tolist(), n
        assert t.decode_runs([e[:7], e])[1].tolist() == t.decode(e[None])[0].tolist()


def test_windows_cover_each_cue():
    text = "x" * 500 + "@" + "y" * 130 + "7"
    starts = pii._cued(text)
    for at in (500, 631):
        assert any(s <= at < s + pii.WINDOW for s in starts)
    assert starts == sorted(set(starts)) and pii._cued("no cue") == [] and pii._cued("5") == [0]


def test_reconciling_takes_the_heaviest_set():
    found = {("email", 0, 10): 2.0, ("phone", 8, 20): 3.0, ("ip", 20, 25): 1.0, ("card", 0, 25): 5.5}
    assert pii.reconcile(found) == [("card", 0, 25)]
    found[("card", 0, 25)] = 3.5
    assert pii.reconcile(found) == [("phone", 8, 20), ("ip", 20, 25)]


def test_personal_data_operator(spark, tagger):
    df = spark.createDataFrame([(1, None, "k"), (2, "a@b.cd", "k"), (2, "a@b.cd", "k")], "doc_id long, text string, spans string")
    rows = pii.find(df, tagger=tagger).collect()
    assert sorted((r.doc_id, [(s.kind, s.start, s.end, s.base) for s in r.spans]) for r in rows) == [(1, []), (2, [("email", 0, 6, True)]), (2, [("email", 0, 6, True)])]
    assert pii.find(df.limit(0), tagger=tagger).count() == 0


def test_weak_parts_need_their_complement():
    token = "q7Xv9Lr2Kp4Zt8Wb3Nc6Yd"
    alone = f"some text {token} and more"
    assert secrets.scan_text(alone) == ([], [])
    both = f"client_id = svc-report-01\nhere {token} it is"
    kinds = [k for k, _, _ in secrets.scan_text(both)[1]]
    assert kinds == ["ident", "secret"]
    apart = f"client_id = svc-report-01\n\nhere {token} it is"
    assert secrets.scan_text(apart)[1] == []
    far = "client_id = svc-report-01 " + "word " * 100 + token
    assert secrets.scan_text(far)[1] == []
    whole = f"see https://db.example.com/x client_id=svc-report-01 {token}"
    assert [k for k, _, _ in secrets.scan_text(whole)[1]] == ["endpoint", "ident", "secret"]
    assert secrets.scan_text("see https://db.example.com/x client_id=svc-report-01")[1] == []


@pytest.mark.parametrize("n", [100, 128, 129, 200, 350, 5000])
def test_long_weak_secrets_are_linked(n):
    r = random.Random(n)
    token = "a1" + "".join(r.choice("ABCDEFGHabcdefgh0123456789") for _ in range(n - 2))
    for text in (f"client_id = svc-report-01\nhere {token} it is", f"here {token} it is\nclient_id = svc-report-01"):
        ident, at = text.index("client_id"), text.index(token)
        assert secrets.scan_text(text)[1] == sorted([("ident", ident, ident + 25), ("secret", at, at + n)], key=lambda s: s[1])
    text = f"client_id = svc-report-01 password={token}"
    assert secrets.scan_text(text) == ([("assign", 26, 35 + n)], [("ident", 0, 25)])


def test_redaction(spark):
    rows = [(1, None, 1), (2, "plain", 5), (3, "a password=abcdefgh12 b", 23), (4, 'token = "' + "ab" * 20 + '" end', 0)]
    out = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert out == {1: None, 2: "plain", 3: "a [SECRET] b", 4: '[SECRET]" end'}


def test_licenses():
    s = licenses.Scanner()
    for name, wordings in licenses.TEMPLATES.items():
        for wording, _ in wordings:
            assert s.match(wording).license == name and s.match(wording).lacking == 0
    assert s.match("Prose about many things. Licensed under CC BY-NC 4.0. And then more prose of other kinds follows here.").license == "CC-BY-NC-4.0"
    assert s.match("Licensed under the Apache License, Version 1.1.") is None
    assert s.match("The license of the driver was old.") is None
    assert s.scan("") == [] and s.scan("no cue") == []
    text = "x\nReleased under the MIT License.\n\nReleased under the MIT License."
    assert [(text[a:b], m.license) for a, b, m in s.scan(text)] == [("Released under the MIT License.", "MIT")] * 2


@pytest.mark.parametrize("name", ["MIT", "CC-BY-4.0", "CC-BY-NC-4.0", "Unlicense"])
def test_licenses_in_long_lines(name):
    s, r = licenses.Scanner(), random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9))) for _ in range(n // 6))
    for _ in range(10):
        assert s.match(f"{prose(10_000)}. {licenses.TEMPLATES[name][0][0]} {prose(10_000)}").license == name


def test_wrapped_tagged_and_several_licenses():
    s = licenses.Scanner()
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights"""
    bsd = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
    moz = "# This Source Code Form is subject to the terms of the\n# Mozilla Public\n# License, v. 2.0."
    cc = "// This work is licensed under a Creative\n// Commons Attribution 4.0 International License."
    for text, name in ((mit, "MIT"), (bsd, "BSD-3-Clause"), (moz, "MPL-2.0"), (cc, "CC-BY-4.0")):
        assert [(a, b, m.license) for a, b, m in s.scan(f"x\n\n{text}\n\ny")] == [(3, 3 + len(text), name)]
    of = lambda text: [m and m.license for _, _, m in s.scan(text)]
    assert of("# SPDX-License-Identifier: MIT") == ["MIT"]
    assert of("/* SPDX-License-Identifier: (GPL-2.0-or-later OR Apache-2.0) */\nint x;") == ["Apache-2.0", "GPL-2.0"]
    assert of("SPDX-License-Identifier: Zlib") == [None]
    assert of("Released under the MIT License or the Apache License, Version 2.0.") == ["Apache-2.0", "MIT"]
    assert of("Licensed under CC BY 4.0 for text that we wrote and licensed under CC BY-SA 4.0.") == ["CC-BY-4.0", "CC-BY-SA-4.0"]
    assert of("This work is licensed under the GNU Lesser General Public License, version 3.") == ["LGPL-3.0"]
    assert of("Released under the\n\nMIT License.") == [None]


def test_license_operator(spark):
    df = spark.createDataFrame([(1, None), (2, "Licensed under CC BY 4.0."), (3, "licence unknown")], "doc_id long, text string")
    got = {r.doc_id: [b.license for b in r.blocks] for r in licenses.scan(df).collect()}
    assert got == {1: [], 2: ["CC-BY-4.0"], 3: [None]}
