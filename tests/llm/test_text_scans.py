"""Operators that judge each text alone, against plain versions of their contracts."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import time
import urllib.parse
import zlib

import pyarrow as pa
import pytest
import zstandard
from gridloom.llm import decontaminate, licenses, pii, secrets, tokens

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text):
    return (text or "").translate(str.maketrans(UP, LOW))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def both(odd, docs):
    return [(odd[0], [(r[0], r[1]) for r in odd[1]]), (docs[0], [(r[0], r[1]) for r in docs[1]])]


def brute_contamination(text, items, window=10):
    words = ALNUM.findall(lower(text))
    hit, names, longest = set(), set(), 0
    for item, content in items:
        own = ALNUM.findall(lower(content))
        if not own:
            continue
        w = min(window, len(own))
        starts = {}
        for t in range(len(own) - w + 1):
            starts.setdefault(tuple(own[t : t + w]), []).append(t)
        for i in range(len(words) - w + 1):
            for t in starts.get(tuple(words[i : i + w]), ()):
                hit |= set(range(i, i + w))
                names.add("" if item is None else str(item))
                n = w
                while i + n < len(words) and t + n < len(own) and words[i + n] == own[t + n]:
                    n += 1
                longest = max(longest, n)
    return len(words), len(hit), len(names), sha(",".join(sorted(names))), bool(hit), longest, min(hit, default=None)


@pytest.mark.parametrize("block_bytes", [1 << 24, 2000])
def test_contamination_matches_brute_force(spark, odd, docs, block_bytes):
    items = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    items += [(7, "the a of"), (None, "one"), (900, None), (901, ""), (902, "x " * 60), (903, "two words"), (7, "three more WORDS"), (905, " ".join((odd[1][8][1]).split()[5:25]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for df, rows in both(odd, docs):
        got = by_row(decontaminate.report(df, bench, block_bytes=block_bytes), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "first_hit")
        assert got == sorted(((d, *brute_contamination(t, items)) for d, t in rows), key=repr)


def test_suffix_order_and_windows():
    import random

    import numpy as np

    rnd = random.Random(6)
    for _ in range(200):
        parts = [[rnd.randrange(1, rnd.choice([2, 3, 9])) for _ in range(rnd.randrange(0, 40))] for _ in range(rnd.randrange(1, 6))]
        ids = np.array([x for p in parts for x in [*p, 0]] + [0])
        text = decontaminate.Text(ids)
        suffix = lambda i: tuple(ids[i : i + text.left[i]].tolist())  # noqa: B023, E731
        at, _ = decontaminate.suffix_order(text, np.flatnonzero(ids), rnd.randrange(1, 4), 10)
        assert [suffix(i) for i in at] == sorted(suffix(i) for i in np.flatnonzero(ids))
        if len(at):
            a, b = (np.array([rnd.choice(at) for _ in range(50)]) for _ in range(2))
            want = [next((k for k in range(50) if k >= len(suffix(x)) or k >= len(suffix(y)) or suffix(x)[k] != suffix(y)[k])) for x, y in zip(a, b, strict=True)]
            assert decontaminate.common(text, a, text, b).tolist() == want


def test_contamination_of_repetitive_texts(spark):
    import time

    words = [f"w{i}" for i in range(20_000)]
    items = [(1, "x " * 20_000), (2, "a b " * 4_000), (3, " ".join(words)), (4, "x y")]
    texts = ["x " * 15_000, "z " + "a b " * 3_000 + "c", " ".join(words[5:19_000]), "b a " * 40, "x y x", "nothing here"]
    began = time.time()
    tests = decontaminate._pass([(str(i), t.encode()) for i, t in items], 10)()
    import pyarrow as pa

    out = tests(pa.array(texts))
    assert time.time() - began < 6
    assert out["longest_match"] == [15_000, 6_000, 18_995, 80, 2, 0]
    assert out["items"] == [["1"], ["2"], ["3"], ["2"], ["4"], []]
    assert [len(x) for x in out["hits"]] == [1, 1, 1, 1, 1, 0]


def test_contamination_edges(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in decontaminate.report(odd[0], none).collect())
    assert decontaminate.report(empty, none).count() == 0
    bench = spark.createDataFrame([(1, "three more words")], "item_id long, text string")
    left = decontaminate.decontaminated(odd[0], bench)
    assert left.columns == odd[0].columns and left.count() == odd[0].count() - 2


def brute_labels(text):
    words = ALNUM.findall(lower(text))
    found = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan(odd, docs, empty):
    for df, rows in both(odd, docs):
        out = licenses.report(df)
        assert by_row(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(((d, *brute_labels(t)) for d, t in rows), key=repr)
        for r in out.collect():
            assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert licenses.report(empty).count() == 0


def brute_suppressed(found, of):
    kept = []
    for i, a, b in sorted(found, key=lambda x: (of[x[0]].priority, x[1] - x[2], x[1], x[0])):
        if not of[i].priority or not any(c <= a and b <= d for _, c, d in kept):
            kept.append((i, a, b))
    return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


def test_suppression_by_containment():
    import random

    rnd = random.Random(1)
    of = licenses.rules()
    for _ in range(300):
        found = [(rnd.randrange(len(of)), a := rnd.randrange(30), a + rnd.randrange(1, 12)) for _ in range(rnd.randrange(12))]
        assert licenses.suppressed(found, of) == brute_suppressed(found, of)
    assert len(of) > 200


def plain(pattern, text, check, flags=0):
    return [m.span() for m in re.finditer(pattern, text, flags) if check(m)]


def variants(parsed):
    """Texts that an expression matches, such that every alternative and every optional part is in one of them and left out of one."""
    out = [""]
    for op, of in parsed:
        op = str(op)
        if op == "LITERAL":
            more = [chr(of)]
        elif op == "IN":
            more = [chr(x if str(k) == "LITERAL" else x[0]) for k, x in of]
        elif op == "SUBPATTERN":
            more = variants(of[-1])
        elif op == "BRANCH":
            more = [x for branch in of[1] for x in variants(branch)]
        else:
            assert op == "MAX_REPEAT" and of[:2] == (0, 1)
            more = ["", *variants(of[2])]
        n = max(len(out), len(more))
        out = [out[i % len(out)] + more[(i + i // len(more)) % len(more)] for i in range(n if len(out) == 1 or len(more) == 1 else 2 * n)]
    return list(dict.fromkeys(out))


def test_every_license_rule_can_fire(spark):
    scanner = licenses.Scanner()
    for i, r in enumerate(scanner.rules):
        given = [x.replace(",", "") for x in variants(re._parser.parse(r.regex))]
        assert len(given) >= r.regex.count("|") + 1
        for x in given:
            norm = licenses.normalised(x.encode())
            assert re.search(rb"(?<= )(?:" + r.regex.encode() + rb")(?= )", norm), (r, x)
            assert any(i in scanner.by_keyword[k] for k in scanner.by_keyword if k in norm), (r, x)
            assert scanner.detect(norm), (r, x)
    by_hand = {
        "SPDX-License-Identifier: MPL-2.0": "mpl-2", "https://opensource.org/licenses/EPL-2.0": "epl-2", "licensed under the PSF license": "python", "released under the Expat license": "mit", "the zero-clause BSD license": "0bsd",
        "Mozilla Public License version 1.1": "mpl-1.1", "Mozilla Public License, v. 2.0": "mpl-2", "the Mozilla Public License": "mpl", "Eclipse Public License version 1.0": "epl-1", "Eclipse Public License - v 2.0": "epl-2", "artistic license 1.0": "artistic-1", "Artistic License 2.0": "artistic-2",
        "GNU General Public License version 2": "gpl-2", "GNU General Public License, version 3": "gpl-3", "GNU General Public License": "gpl", "GPL v2": "gpl-2", "GPLv3": "gpl-3", "GPL 2.0": "gpl-2", "LGPL v2.1": "lgpl-2.1", "GNU Lesser General Public License v3": "lgpl-3", "GNU Affero General Public License v3": "agpl-3",
        "Apache License, Version 2.0": "apache-2", "Apache License 1.1": "apache-1.1", "the Apache License": "apache", "Apache Software License, Version 1.1": "apache-1.1", "CC BY-SA 4.0": "cc-by-sa", "CC BY-NC-SA 3.0": "cc-by-nc,cc-by-nc-sa", "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa",
        "http://www.gnu.org/licenses/old-licenses/gpl-2.0.html": "gpl-2", "https://creativecommons.org/publicdomain/zero/1.0/": "cc0-1", "under the MIT license": "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit", "CDDL": "cddl", "Boost Software License 1.0": "boost-1",
        "licensed under the apache license version 2 0": "apache-2", "licensed under the GNU General Public License version 3": "gpl-3", "Text is under the CC BY-NC 4.0 license": "cc-by-nc", "the CC BY-NC 4.0": "cc-by-nc", "a CC BY-SA 4.0 license": "cc-by-sa", "released under the LGPL v3": "lgpl-3", "under the GPL, version 2": "gpl-2",
        "the BSD license: bsd 3-clause license": "bsd,bsd-3-clause", "the GPL license and GPLv3": "gpl,gpl-3", "the CC BY license, not CC BY-NC": "cc-by,cc-by-nc", "Apache-2.0": "apache-2", "EUPL v1.2": "eupl-1.2", "available under the ISC": "isc", "Creative Commons Zero v1.0 Universal": "cc0-1", "under the Apache License. Version 2 of this work": "apache-2", "the Artistic License 2.0": "artistic-2",
        "see the license for the specific language": "", "a permissive mood": "", "ruby rings and python skins": "", "mit freundlichen grüßen": "", "version 2 of the plan": "", "we apply apache helicopters": "",
    }
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(by_hand)], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"] > 0) for r in licenses.report(docs).collect()}
    assert [got[i] for i in range(len(by_hand))] == [(label, bool(label)) for label in by_hand.values()]


def test_license_detections_match_brute_force(odd, docs):
    """All rules on all texts without keywords, then containment by all pairs."""
    scanner = licenses.Scanner()
    texts = [t or "" for _, t, *_ in [*odd[1], *docs[1]] if len(t or "") < 20_000]
    texts += ["This is free software: GNU General Public License version 2, or the MIT License; see http://www.apache.org/licenses/LICENSE-2.0, CC BY-NC-SA 4.0. All rights reserved."]
    assert sum(bool(scanner.detect(licenses.normalised(t.encode()))) for t in texts) > 3
    for t in texts:
        norm = licenses.normalised(t.encode())
        every = [(i, m.start(), m.end()) for i, r in enumerate(scanner.rules) for m in re.finditer(rb"(?<= )(?:" + r.regex.encode() + rb")(?= )", norm)]
        assert scanner.detect(norm) == brute_specific(brute_suppressed(every, scanner.rules), scanner.rules)


def brute_specific(found, of):
    member = lambda i, j: of[j].label.startswith(of[i].label + "-")
    return [(i, a, b) for i, a, b in found if not of[i].priority or not any(member(i, j) and c < b and a < d for j, c, d in found)]


def test_license_families_against_all_pairs():
    rnd, rules = random.Random(9), licenses.rules()
    near = [i for i, r in enumerate(rules) if r.label.split("-")[0] in ("cc", "gpl", "apache", "mit")]
    for _ in range(300):
        found = sorted({(rnd.choice(near), a, a + rnd.randrange(1, 9)) for a in (rnd.randrange(40) for _ in range(rnd.randrange(12)))}, key=lambda x: (x[1], x[2], x[0]))
        assert licenses.specific(found, rules) == brute_specific(found, rules)


def brute_pii(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    kinds = {
        "email": plain(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text, lambda m: True) if "@" in text else [],
        "ip": plain(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text, lambda m: all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))),
        "card": plain(r"[0-9]([\x20-]?[0-9])+", text, lambda m: 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))),
        "phone": plain(r"\+[0-9][\x20().0-9-]+[0-9]", text, lambda m: 9 <= len(digits(m)) <= 15),
    }
    spans = sorted((a, pii.KINDS.index(k), b, k) for k, of in kinds.items() for a, b in of)
    return *(len(of) for of in kinds.values()), sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans))


OLD_FORMS = {
    "token": r"[^\s]*[0-9@][^\s]*", "spelled": r"[A-Za-z0-9._+-]+ ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[({](?:dot|DOT)[\])}] ?)[A-Za-z0-9-]+)+", "numbers": r"\(?[0-9]+(?:[ ().-]{1,2}[0-9]+)+",
}


def test_pii_forms_equal_their_plain_expressions():
    rnd = random.Random(4)
    parts = ["a", "b.c", "12", "7", " ", "  ", "(", ")", "[at]", "(at)", "{AT}", "[dot]", "(dot)", ".", "-", "@", "é", "\n"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))
        plain = {k: [m.span() for m in re.finditer(x, text)] for k, x in OLD_FORMS.items()}
        assert pii.spelled(text) == plain["spelled"], text
        assert [m.span() for m in pii._NUMBERS.finditer(text)] == plain["numbers"], text
        assert [m.span() for m in re.finditer(r"\S+", text) if pii._MARKED.search(m.group())] == plain["token"], text


@pytest.mark.parametrize("unit", ["日本語の文章", "a", "1", "日1234567", "ab(at)", "x@", "1.2.3.4日", "+1 ", "(", "a[at]b[dot]", "日+1 614 555 8001日a@b.cd"])
def test_pii_is_linear(unit):
    """A million characters without a space, or of one form: about as many seconds as characters, against a tenth of them."""
    def took(n):
        text, began = unit * (n // len(unit)) + "(", time.process_time()
        pii._start()(pa.array([text]))
        return time.process_time() - began

    took(10_000)
    assert took(1_000_000) < 25 * took(100_000) + 1


def test_pii_patterns_of_long_words():
    long = "x" * 300
    a, b = pii.Words(f"{long}12 mail y{long}13 z"), pii.Words(f"{long}12 mail")
    at = len(long) + 2
    assert a.before(at, 2) == b.before(at, 2) and a.before(at, 2)[0].split()[0] == "302"
    assert a.before(at - 1, 1) != a.before(at, 1)
    assert a.after(len(long) + 3, 2)[0] == "mail" and a.after(len(long) + 3, 2)[1].split()[0] == "303"
    assert pii.Words("Mail 12 a").before(7, 2) == ["mail", "0"]


def test_pii_base(odd, docs, empty):
    for df, rows in both(odd, docs):
        out = pii.report(df)
        assert by_row(out, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(((d, *brute_pii(t)) for d, t in rows), key=repr)
    assert pii.report(empty).count() == 0


def test_pii_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"text {i} my number is +1 (614) 555-{8000 + i} thanks and bye") for i in range(8)]
    rows += [(100, "so my number is 614-555-9999 thanks a lot"), (101, "the build 12345678 went well"), (102, "my number is +1 614 555 1234 thanks")]
    out = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[8][1].index("614")
    assert out[100]["spans"] == f"phone:{at}:{at + 12}" and out[100]["n_phone"] == 0 and out[100]["n_added"] == 1
    assert out[101]["spans"] == ""
    assert out[102]["n_phone"] == 1 and out[102]["n_added"] == 0


def brute_bootstrap(texts):
    """The spans that the method adds to each text, in plain Python: patterns and instances scored until nothing changes."""
    places = []  # text, start, end, kind or None, instance, patterns
    for i, x in enumerate(texts):
        base = pii.base_spans(x)
        words = [(m.start(), m.end()) for m in re.finditer(r"\S+", x)]
        for a, b, kind in [(a, b, k) for k, a, b in base] + [(a, b, None) for a, b in pii.candidates(x, base)]:
            mask = lambda s: re.sub("[0-9]+", "0", s.lower())
            left, right = [mask(w) for w in x[:a].split()[-2:]], [mask(w) for w in x[b:].split()[:2]]
            of = ["L " + " ".join(left)] * bool(left) + ["R " + " ".join(right)] * bool(right) + ([f"B {left[-1]} _ {right[0]}"] if left and right else [])
            places.append((i, a, b, kind, x[a:b].lower(), of))
        assert len(words) == len(x.split())
    members, seeds = {}, {}
    for _, _, _, kind, instance, of in places:
        if kind:
            seeds[instance, kind] = 1.0
        for p in of:
            members.setdefault(p, set()).add(instance)
    score = dict(seeds)
    while True:
        sure = {}
        for p, of in members.items():
            for kind in pii.KINDS:
                n, c = len(of), sum(score.get((x, kind), 0.0) for x in of) / len(of)
                z = 1.96
                if (c + z * z / (2 * n) - z * (max(0.0, c * (1 - c) / n) + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n) >= 0.5:
                    sure[p, kind] = c
        new = dict(seeds)
        for instance in {x for of in members.values() for x in of}:
            for kind in pii.KINDS:
                miss = 1.0
                for p, of in members.items():
                    if instance in of and (p, kind) in sure:
                        miss *= 1 - sure[p, kind]
                if miss < 1:
                    new[instance, kind] = max(new.get((instance, kind), 0.0), 1 - miss)
        if all(abs(new[k] - score.get(k, 0)) < 1e-9 for k in new):
            break
        score = new
    out = [set() for _ in texts]
    for i, a, b, kind, _, of in places:
        best = max(((c, pii.KINDS.index(k)) for (p, k), c in sure.items() if p in of), default=None)
        if kind is None and best:
            out[i].add((a, best[1], b))
    return [sorted(x) for x in out]


def test_pii_bootstrap_matches_brute_force_and_finds_most(spark):
    import random

    rnd = random.Random(12)
    noise = lambda n: " ".join(rnd.choice(["red", "blue", "tree", "house", "walks", "under", "green", "water", "9", "77"]) for _ in range(n))
    phone = lambda plus: f"{'+1 ' if plus else ''}({rnd.randrange(200, 999)}) 555-{rnd.randrange(1000, 9999)}"
    mail = lambda plain: f"{rnd.choice('abcdef')}{rnd.randrange(999)}{'@' if plain else ' [at] '}mail{rnd.randrange(9)}.example.com"
    forms = [("phone", "call me on", "any time", phone), ("phone", "my desk is", "after lunch", phone), ("email", "write to", "for details", mail), ("email", "contact address", "or visit", mail)]
    texts, hidden = [], []
    for i in range(160):
        kind, before, after, make = forms[i % 4]
        seen = rnd.random() < 0.8
        thing = make(seen)
        texts.append(f"{noise(6)} {before} {thing} {after} {noise(6)} order 20{rnd.randrange(10, 99)}{rnd.randrange(10, 99)} {noise(3)}")
        hidden.append(None if seen else (texts[-1].index(thing), pii.KINDS.index(kind), texts[-1].index(thing) + len(thing)))
    # a pattern that only identifiers found by another pattern stand in
    many = [phone(False) for _ in range(8)]
    texts += [f"{noise(3)} call me on {n} any time {noise(3)}" for n in many] + [f"{noise(3)} ring the bell at {n} or knock {noise(3)}" for n in [*many, "555-1234-99"]]
    want = brute_bootstrap(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["spans"] for r in pii.report(rows).collect()}
    for i, x in enumerate(texts):
        every = sorted([(a, pii.KINDS.index(k), b) for k, a, b in pii.base_spans(x)] + want[i])
        assert got[i] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in every), x
    right = sum(h in w for h, w in zip(hidden, want, strict=False) if h)
    assert right >= 0.95 * sum(h is not None for h in hidden) and right >= 0.95 * sum(map(len, want[:160]))
    assert len(want[-1]) == 1 and len(want[160]) == 1


def brute_secrets(text):
    text = text or ""
    kinds = {
        "assign": plain(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, lambda m: len(m[2]) >= 6, re.I | re.A),
        "access": plain(r"AKIA[A-Z0-9]+", text, lambda m: len(m[0]) >= 20),
        "hex": plain(r"[0-9a-f]+", text, lambda m: len(m[0]) >= 24),
    }
    spans = sorted((a, secrets.KINDS.index(k), b, k) for k, of in kinds.items() for a, b in of)
    return *(len(of) for of in kinds.values()), sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans))


def test_secret_base(odd, docs, empty):
    for df, rows in both(odd, docs):
        assert by_row(secrets.report(df), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(((d, *brute_secrets(t)) for d, t in rows), key=repr)
    assert secrets.report(empty).count() == 0


def test_secrets_in_layers(odd):
    secret = 'password = "hunter2hunter2"'
    found = {t: secrets.scan_text(t)[1] for _, t, *_ in odd[1] if t}
    deep = [t for t in found if secret not in t and found[t]]
    assert len(deep) == 5 and all(x[0] == "assign" for t in deep for x in found[t])
    chains = sorted(x[3] for t in deep for x in found[t])
    assert chains == ["base64", "base64>base64>url", "base64>inflate", "unicode", "url"]
    escaped = next(t for t in deep if t.startswith("q="))
    (kind, a, b, _), = found[escaped]
    assert escaped[a:b].startswith("%70%61") and (b - a) % 3 == 0


def test_secret_cycles_bombs_and_redaction(spark):
    import base64
    import zlib

    assert secrets.scan_text("%2525252525252525") == ([], [])
    # a layer of many windows, with a secret across two of them, is scanned whole and in bounded memory
    tail = b'password = "hunter2hunter2"'
    for at in (0, 5000, 99_990, 100_003, 10_000_000):
        bomb = base64.b64encode(zlib.compress(b" " * at + tail + b" " * 1_000_000)).decode()
        _, added = secrets.scan_text("x " + bomb, size=100_000, overlap=1000)
        assert [x[0] for x in added] == ["assign"], at
    df = spark.createDataFrame([(1, "a token=abcdefgh b", 18), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in secrets.redact(df).orderBy("doc_id").collect()] == [(1, "a [REDACTED] b", 14), (2, None, None), (3, "clean", 5)]


def test_secrets_in_members_and_deep_escapes():
    import base64
    import bz2
    import gzip
    import lzma
    import time

    import zstandard

    short = b'password = "hunter2hunter2"'
    packs = {"gzip": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress, "zstd": zstandard.ZstdCompressor().compress}
    found = lambda raw, **o: [x[0] for x in secrets.scan_text("see " + base64.b64encode(raw).decode(), **o)[1]]
    for name, pack in packs.items():
        for raw in (pack(short), pack(b"first") + pack(short), pack(b"") + pack(b"x" * 3000) + pack(short) + b"end", pack(b"y" * 70_000 + short)):
            assert found(raw) == ["assign"], name
            assert found(raw, size=4096, overlap=100) == ["assign"], name
        for other in packs.values():
            assert found(other(pack(short))) == ["assign"], name
        assert found(pack(b"nothing here at all")) == [] and found(pack(short)[:-9] + b"broken") in ([], ["assign"])
    for deep in ("%" + "25" * 3000 + "41", "\\" + "u005c" * 3000 + "u0041", "&" + "#38;" * 3000 + "#65;"):
        began = time.time()
        (layer,) = [x for x in map(lambda f: secrets.unescaped(secrets.Layer(deep), f), ("url", "unicode")) if x]
        assert layer.text == "A" and layer.span(0, 1) == (0, len(deep))
        secrets.scan_text(deep)
        assert time.time() - began < 0.3
    escaped = "%" + "25" * 40 + "70assword%3" + "D hunter2hunter2"
    assert [x[0] for x in secrets.scan_text(escaped)[1]] == ["assign"]


def test_secrets_in_wrapped_glued_and_binary_segments():
    import base64
    import gzip
    import random
    import textwrap

    rnd = random.Random(8)
    noise = "".join(rnd.choice("ghijklmn opqrstuvw xyz.,") for _ in range(300))
    secret = noise + ' password = "hunter2hunter2" ' + noise
    of = lambda raw: base64.b64encode(raw).decode()
    found = lambda text: [text[a:b] for k, a, b, _ in secrets.scan_text(text)[1] if k == "assign"]
    for width in (64, 76):
        for raw in (secret.encode(), gzip.compress(secret.encode(), mtime=0)):
            lines = textwrap.wrap(of(raw), width)
            for glue in ("\n", "\r\n", "\n  ", "\n> ", "\\n"):
                block = glue.join(lines)
                for text in (block, f"see {block}\nthe end", f"-----BEGIN CERTIFICATE-----{glue}{block}{glue}-----END CERTIFICATE-----", f"a word\n{block}\n"):
                    # whatever is found lies in the block, and the widest find is all of it but for the padding
                    assert any(x.rstrip("=") in block and len(x) >= len(block.rstrip("=")) - width for x in found(text)) or any(block.rstrip("=") in x for x in found(text)), (width, glue, text)
    short = 'password = "hunter2hunter2"'
    assert found("see " + "\n".join(textwrap.wrap(of(("pass" * 10 + short).encode()), 64)))
    for raw in (short.encode(), gzip.compress(short.encode(), mtime=0)):
        for before in ("/data/", "key_", "a-b-", "x/y_z/", "ab_"):
            assert found(f"open {before}{of(raw)} now"), (before, raw)
    for raw in (b"\x01" + short.encode(), short.encode() + b"\xff\x00", short.encode("utf-16"), short.encode("utf-16-be"), gzip.compress(short.encode("utf-16-le"))):
        assert found(f"see {of(raw)} there"), raw
    assert secrets.redacted(text := f"see {of(short.encode('utf-16'))} there", [x for part in secrets.scan_text(text) for x in part]).count("[REDACTED]") == 1
    assert secrets.scan_text("/usr/lib/python_site-packages/" + "some_longer-name/" * 2000)[1] == []


def test_token_counts(odd, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    for df, rows in both(odd, docs):
        want = [(d, len((t or "").encode()), n := len(own.encode(t or "", add_special_tokens=False)), n > 512) for d, t in rows]
        assert by_row(tokens.report(df), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert tokens.report(empty).count() == 0


def test_token_pieces_are_safe_and_memo_is_bounded():
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st

    counter = tokens.Counter(public_tokenizers.path(tokens.TOKENIZER), memo=5)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(st.sampled_from("ab1é \n\t\xa0\x85\x1c'.s<|>"), max_size=30), max_size=4))
    def check(items):
        assert counter.counts(items) == counter.encode(items)
        assert len(counter.known) <= 5 + sum(map(len, items))
        assert [sum(counter.encode(tokens.stretches(x, 4))) for x in items] == counter.encode(items)

    check()


def test_token_batches_and_pieces_without_text(spark):
    rnd = __import__("random").Random(3)
    sizes = [rnd.randrange(0, 300) for _ in range(200)] + [0, 0, 5000]
    got = tokens.batches(sizes, 1000)
    assert sorted(i for b in got for i in b) == list(range(len(sizes)))
    assert all(len(b) == 1 or sum(sizes[i] for i in b) <= 1000 for b in got) and tokens.batches([0]) == [[0]] and tokens.batches([]) == []
    long = "".join(rnd.choice(["word", "123", "\t", "\n ", "é", "<|endoftext|>"]) for _ in range(9000))
    assert len(tokens.stretches(long)) > 5 and "".join(tokens.stretches(long)) == long
    for items in ([None], [""], ["hello "], [" "], [None, "", "a "], [long]):
        want = [len(tokens.Counter(__import__("public_tokenizers").path(tokens.TOKENIZER)).tokenizer.encode(x or "", add_special_tokens=False)) for x in items]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "doc_id long, text string")
        assert [r["n_tokens"] for r in tokens.report(df).orderBy("doc_id").collect()] == want


SECRET = 'password = "hunter2hunter2" and some more words around it, as a file would have'


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_compressed_bytes_in_escapes(pack):
    """Compressed bytes written as percent escapes or as escapes of program texts, in whole or where they must be."""
    raw = pack(SECRET.encode() * 3)
    forms = [urllib.parse.quote_from_bytes(raw), urllib.parse.quote_from_bytes(raw, safe=""), "".join(f"%{b:02x}" for b in raw), urllib.parse.quote(urllib.parse.quote_from_bytes(raw)), repr(raw)[2:-1], "".join(f"\\x{b:02x}" for b in raw), "".join(f"\\u{b:04X}" for b in raw)]
    for form in forms:
        for before, after in (("see ", " there"), ("q=", "\n"), ("", "")):
            _, added = secrets.scan_text(before + form + after)
            spans = {(k, a, b) for k, a, b, _ in added}
            assert ("assign", len(before), len(before) + len(form)) in spans, (form[:40], added)


def test_large_window_zstd():
    for log in (20, 27, 28, 30):
        params = zstandard.ZstdCompressionParameters.from_level(1, window_log=log)
        packer = zstandard.ZstdCompressor(compression_params=params).compressobj()
        raw = packer.compress(SECRET.encode()) + packer.flush()
        assert [k for k, *_ in secrets.scan_text("x " + base64.b64encode(raw).decode())[1]] == ["assign"], log


def alternated(text, depth):
    for k in range(depth):
        text = text.replace("%", "\\u0025") if k % 2 == 0 else text.replace("\\", "%5C")
    return text


def test_alternating_escapes():
    whole = "".join(f"%{b:02X}" for b in b"password=hunter2hunter2")
    for depth in range(9):
        text = "a " + alternated(whole, depth) + " z"
        found = [(k, a, b) for k, a, b, _ in secrets.scan_text(text)[1]]
        assert ("assign", 2, len(text) - 2) in found, depth
    for text in ("%%34%31bc", "&#37;41", "&#x25;4&#49;", "%26%2337%3b41", "\\u{25}41", "%C3%A9", "%C3x%A9", "\\ud800", "\\u5", "%"):
        layer, before = secrets.Layer(text), None
        while layer is not None and layer.text != before:  # one level after another comes to the same
            before = layer.text
            layer = secrets.unescaped(layer, "url") or layer
            layer = secrets.unescaped(layer, "unicode") or layer
        assert secrets.resolved(secrets.Layer(text)).text == layer.text, text


def test_escapes_are_linear():
    def took(n):
        began = time.process_time()
        secrets.scan_text(alternated("%41" * 20, 2) + "%5Cu0025" * n + " %5Cu0025" + "%5Cu0025".replace("%", "%5Cu0025") * n)
        nested = "%41"
        for _ in range(n // 10):
            nested = nested.replace("%", "\\u0025", 1) if nested[0] == "%" else nested.replace("\\", "%5C", 1)
        secrets.scan_text(nested)
        return time.process_time() - began

    took(100)
    assert took(10_000) < 25 * took(1_000) + 1


def test_blocks_of_short_lines():
    body = base64.b64encode(gzip.compress(SECRET.encode())).decode()
    for width in (4, 12, 15, 76):
        block = "\n".join(body[i : i + width] for i in range(0, len(body), width))
        assert {k for k, *_ in secrets.scan_text(f"key:\n{block}\n\nend")[1]} == {"assign"}, width
