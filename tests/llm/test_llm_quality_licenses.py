"""Quality rules and licence scans."""

import re
from collections import Counter

import pytest

from sheetwise.llm import common as C
from sheetwise.llm import licenses, quality


def measures(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_measures_on_odd_rows(spark, odd_docs, no_docs):
    got = quality.quality(odd_docs)
    rows = [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got.collect()]
    want = [(r.doc_id, measures(r.text)) for r in odd_docs.collect()]
    assert Counter(rows) == Counter(want)
    assert quality.quality(no_docs).count() == 0
    assert all(not r.kept for r in got.where("base_failed").collect())


def test_repeats_overlap(spark):
    texts = ["a b c d e a b c d e f", "a a a a a a a", "a b c d e x b c d e a b c d e", "p q r s t\nu v w x y"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in quality.with_measures(d).collect()}
    assert got == {i: measures(t)[4] for i, t in enumerate(texts)}


def test_filter_keeps_columns_and_agrees_with_labels(spark, odd_docs, sf_dir):
    kept = quality.filter_quality(odd_docs)
    assert kept.schema == odd_docs.schema
    docs, labels = C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")
    q = quality.quality(docs).join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in q) >= 0.95 * len(q)
    clean = [r for r in q if r.quality == 1]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)


def test_em_keeps_rare_faults_apart(spark):
    """Rules with disjoint faults, one of which objects to good documents too."""
    import random
    r = random.Random(3)
    rows = []
    for _ in range(2000):
        kind = r.choices([0, 1, 2, 3], [0.8, 0.08, 0.07, 0.05])[0]
        bad = lambda i, kind=kind: 1 if kind == i and r.random() < 0.95 else -1
        rows.append((bad(1), bad(2), bad(3), 1 if r.random() < (0.9 if kind == 1 else 0.3) else -1 if r.random() < 0.9 else 0, kind))
    d = spark.createDataFrame(rows, "a int, b int, c int, d int, kind int")
    names = ["a", "b", "c", "d"]
    model = quality.fit(d, names)
    got = d.select("kind", (quality.posterior(model, [d[x] for x in names]) >= 0.5).alias("kept"), "a", "b", "c").collect()
    # whatever only the rule d objects to is judged alike; the others decide
    assert all(not r.kept for r in got if 1 in (r.a, r.b, r.c))
    assert all(r.kept for r in got if r.kind == 0 and 1 not in (r.a, r.b, r.c)) or model.share[4] > 0.15


def dice(a, b):
    a, b = set(licenses.bigrams(a)), set(licenses.bigrams(b))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


def plain_scan(text):
    """{licence: (units, windows, best dice)} by comparing everything."""
    templates = [(name, k, re.findall(r"[a-z0-9]+", k.lower()), licenses.anchor_words(licenses.key_words(licenses.bigrams(k), 0.8))) for name, texts in licenses.TEMPLATES.items() for k in texts]

    def best(options):
        found = [(-x, name) for name, x, must, own in options if x >= 0.8 and must <= set(own)]
        return min(found) if found else None

    numbers = lambda words: {w for w in words if re.search("[0-9]", w)}
    low = (text or "").lower()
    paras = re.split(r"\n[\x20\x09-\x0D]*\n", low)
    units = low.split("\n") + [p for p in paras if "\n" in p] + ([low] if len(paras) > 1 else [])
    out = {}
    for u in units:
        if m := best([(name, dice(u, k), numbers(w), re.findall("[a-z0-9]+", u)) for name, k, w, _ in templates]):
            n, k, x = out.get(m[1], (0, 0, 0))
            out[m[1]] = n + 1, k, max(x, -m[0])
    words = re.findall("[a-z0-9]+", low)
    for at, word in enumerate(words):
        options = []
        for name, k, w, keys in templates:
            for place in range(len(w)) if word in keys else ():
                if w[place] == word:
                    own = words[max(at - place, 0):max(at - place, 0) + len(w)]
                    options.append((name, dice(" ".join(own), k), numbers(w), own))
        if m := best(options):
            n, k, x = out.get(m[1], (0, 0, 0))
            out[m[1]] = n, k + 1, max(x, -m[0])
    return out


def test_licences_against_all_templates(spark, odd_docs, no_docs):
    t = licenses.TEMPLATES
    texts = ["intro\n" + t["MIT"][2] + "\nmore", "RELEASED under the  MIT-License!", "Licensed under the Apache Licence, Version 2.0", t["GPL-3.0"][2].replace("program", "work"),
             "x\n\n" + t["BSD"][0][:60] + "\n" + t["BSD"][0][60:] + "\n\ny", "Released under the MIT License\nReleased under the MIT License", "released", "licensed under nothing",
             "see " + " ".join(t["ISC"]) + " and " + t["GPL-2.0"][2], "license " * 50, "2 0 version 2 0 license apache the under licensed", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in licenses.scan(d).collect():
        got.setdefault(r.doc_id, {})[r.licence] = (r.n_units, r.n_windows, pytest.approx(r.dice))
    assert got == {i: found for i, x in enumerate(texts) if (found := plain_scan(x))}
    assert {0, 1, 3, 4, 5, 8} <= got.keys()
    assert licenses.scan(odd_docs).count() == 0 and licenses.scan(no_docs).count() == 0


def test_planted_notices_have_the_right_name(spark):
    prose = "Some words of an ordinary text that says nothing on any terms of use. "
    gpl = licenses.TEMPLATES["GPL-3.0"][2]
    planted = {
        "Copyright 2020 Foo Inc. Licensed under the Apache License, Version 2.0.": {"Apache-2.0"},
        "This project is licensed under the Apache License, Version 2.0 - see LICENSE.": {"Apache-2.0"},
        "Copyright 2020 Foo. Released under the MIT License.": {"MIT"},
        "This work is licensed under the GNU General Public License, version 2": {"GPL-2.0"},
        gpl.replace("version 3", "version 2"): {"GPL-2.0"},
        "the GNU General\nPublic License, version 3 -- this work is licensed\nunder the GNU General Public License,\nversion 3 or so": {"GPL-3.0"},
        "(c) me. Licensed under the BSD 2-Clause License; parts are licensed under the BSD 3-Clause License.": {"BSD-2-Clause", "BSD-3-Clause"},
        "All of it is licensed under CC BY-SA 4.0, the rest is not.": {"CC-BY-SA-4.0"},
        "Photos: This work is licensed under a Creative Commons Attribution 3.0 Unported License (see there)": {"CC-BY-3.0"},
        gpl.replace("General", "Lesser General").replace("program", "library"): {"LGPL-3.0"},
        "Licensed under the Apache License, Version 1.1": set(),
        "A licensed driver under the version of the law": set(),
    }
    rows = [(i, prose * 20 + text + " " + prose * 20) for i, text in enumerate(planted)] + [(100 + i, text) for i, text in enumerate(planted)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add(r.licence)
    for i, want in enumerate(planted.values()):
        assert got.get(i, set()) == want and got.get(100 + i, set()) == want, list(planted)[i]


def test_key_words_cover_enough_bigrams():
    for texts in licenses.TEMPLATES.values():
        for text in texts:
            grams = licenses.bigrams(text)
            keys = licenses.key_words(grams, 0.8)
            assert sum(any(k in g.split() for k in keys) for g in grams) >= len(grams) - licenses.needed(len(grams), 0.8) + 1
