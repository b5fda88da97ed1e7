import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np

from brandloom.llm import licenses as L, toxicity as T

RUDE = ["zonk", "blarg", "frubwit", "skoff"]


def _labelled(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('bcdfglmnprstv')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{i}x".replace("0", "o").replace("1", "i") for i in range(300)]
    vocabulary = [re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], v) for v in vocabulary]
    docs, labels = [], []
    for i in range(n):
        words, toxic = rng.choices(vocabulary, k=rng.randrange(5, 120)), rng.random() < 0.15
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(RUDE) + rng.choice(["", "ed", "ing"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = _labelled(3000)
    d = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, score double")
    model = T.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in T.score(d, model).collect()}
    held = [(got[i].predicted, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert np.mean([p == y for p, y in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    kept = T.keep_clean(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_scores_of_odd_rows(spark):
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "x"), (2, "same", "x"), (2, "same", "x"), (3, "w" * 200_000, None)], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = T.score(odd, T.train(odd, none)).collect()
    assert len(rows) == 5 and {r.predicted for r in rows} == {0}
    assert T.score(odd.limit(0), T.train(odd.limit(0), none)).count() == 0


def test_wrong_labels_are_overruled(spark):
    """Labels choose the voters only: posteriors follow the votes where a label is wrong."""
    docs, labels = _labelled(3000, seed=4)
    rng, truth = random.Random(5), dict(labels)
    given = [(i, 1 - y if rng.random() < 0.04 else y) for i, y in labels]
    wrong = {(i, y) for i, y in given if y != truth[i] and zlib.crc32(str(i).encode()) % 5}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = T.train(d, spark.createDataFrame(given, "doc_id long, toxic int"))
    assert model["overruled"]["to_clean"] >= 0.9 * sum(y for _, y in wrong) and model["overruled"]["to_toxic"] >= 0.8 * sum(1 - y for _, y in wrong)
    assert model["overruled"]["to_clean"] + model["overruled"]["to_toxic"] < 1.5 * len(wrong)
    got = {r.doc_id: r.predicted for r in T.score(d, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i] == truth[i] for i in held]) > 0.97
    caught = [got[i] for i in held if truth[i]]
    assert np.mean(caught) > 0.9


def test_label_model_sees_votes_only():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.15
    alone = lambda hit, false: np.where(y, rng.random(6000) < hit, rng.random(6000) < false)
    first = alone(0.5, 0.01)
    copies = [first & (rng.random(6000) < 0.9) for _ in range(3)]
    votes = np.stack([alone(0.6, 0.02), alone(0.55, 0.01), alone(0.5, 0.02), first, *copies], axis=1)
    post, rates, parent, vocabulary = T.label_model(votes)
    assert len(set(vocabulary.tolist())) == 1 and all(k in parent[4:] or parent[k] >= 3 for k in (3, 4, 5, 6) if parent[k] >= 0)
    assert abs(rates[0, 0] - 0.6) < 0.15 and rates[1, 0] < 0.05
    assert ((post > 0.5) == y).mean() > 0.94


def test_vocabularies_have_classes_of_their_own():
    """Words of two languages never go together; each language's toxic texts are found all the same."""
    rng = np.random.default_rng(1)
    y, second = rng.random(6000) < 0.15, rng.random(6000) < 0.3
    votes = np.stack([np.where(y & (second == (k > 2)), rng.random(6000) < 0.7, rng.random(6000) < 0.003) for k in range(6)], axis=1)
    post, rates, _, vocabulary = T.label_model(votes)
    assert vocabulary.tolist() == [0, 0, 0, 1, 1, 1]
    assert all(((post > 0.5) == y)[second == side].mean() > 0.97 for side in (False, True))
    assert T.label_model(np.zeros((5, 0), bool))[0].tolist() == [0.0] * 5


def _brute(files, threshold=L.THRESHOLD):
    """Best template of each run of lines between lines with a needed token, by dense cosine."""
    tok = lambda s: re.findall(L._TOKEN, s.lower())
    templates = [(n, Counter(tok(t))) for n, t in L.TEMPLATES]
    vocabulary = {t for _, c in templates for t in c}
    n = len(files)
    df = Counter(t for _, _, text in files for t in set(tok(text or "")) & vocabulary)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocabulary}
    other = math.log((1 + n) / 2) + 1
    vector = lambda c: {t: (1 + math.log(k)) * idf.get(t, other) for t, k in c.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    unit = lambda v: {t: x / size(v) for t, x in v.items()}
    needed = set(L.needed_tokens([unit(vector(c)) for _, c in templates], threshold))
    for i, _, text in files:
        best, lines = [], re.split(r"[\r\n]+", text or "")
        ends = [k for k, line in enumerate(lines) if needed & set(tok(line))]
        for k, last in ((a, b) for a in ends for b in ends if a <= b < a + L.WRAPPED):
            v = vector(Counter(tok("\n".join(lines[k : last + 1]))))
            for name, c in templates:
                w = vector(c)
                s = round(sum(v[t] * w[t] for t in v if t in w) / (size(v) * size(w)), 6) if v else 0
                if s >= threshold:
                    best.append((-s, name, k))
        out[i] = (min(best)[1], -min(best)[0], min(best)[2]) if best else (None, None, None)
    return out


def test_licences(spark):
    rng = random.Random(2)
    words = ["the", "license", "version", "of", "under", "code", "data", "mit", "public", "work", "x1", "apache"]
    files = [(k, f"a/b{k % 3}/f{k}.txt", "\n".join(" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(4))) for k in range(60)]
    files += [(100, "a/b0/n.txt", "text\nReleased under the MIT License."), (101, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (102, "a/c/d/e.txt", "nothing here"), (103, "z/y.txt", None), (104, None, ""), (105, "a/c/COPYING", "This work is licensed under the GNU General Public License, version 3.\nreally")]
    frame = spark.createDataFrame([(*f, "MIT") for f in files], "doc_id long, path string, text string, license string")
    got = {r.doc_id: r for r in L.scan_licenses(frame).collect()}
    assert len(got) == len(files)
    for i, (name, similarity, line) in _brute(files).items():
        assert got[i].license == name and got[i].line == line, i
        assert similarity is None or abs(got[i].similarity - similarity) < 1e-5
    assert (got[102].inherited, got[102].licensed_by, got[102].effective) == ("GPL-3.0", "a/c", "GPL-3.0")
    assert got[103].effective is None and got[104].effective is None and got[100].inherited is None
    assert L.scan_licenses(frame.limit(0)).count() == 0


def test_repeated_files(spark):
    frame = spark.createDataFrame([(1, "p/q", "Licensed under CC BY-NC 4.0."), (1, "p/q", "Licensed under CC BY-NC 4.0.")], "doc_id long, path string, text string")
    assert [(r.license, r.line) for r in L.scan_licenses(frame).collect()] == [("CC-BY-NC-4.0", 0)] * 2


def _wrapped(text, mark="", width=60):
    return "\n".join(textwrap.wrap(text, width, initial_indent=mark, subsequent_indent=mark))


def test_wrapped_notices(spark):
    """Every template, wrapped in a comment between code, is found as itself, on its first line."""
    files = [(k, f"s{k}/f.c", "int before;\n" + _wrapped(text, " * ", 90) + "\nint after;") for k, (_, text) in enumerate(L.TEMPLATES)]
    gpl = next(text for name, text in L.TEMPLATES if name == "GPL-3.0" and text.startswith("This program"))
    files += [(1000, "g/COPYING", _wrapped(gpl)), (1001, "g/d/x.c", "code"), (1002, "m/notes.txt", _wrapped(gpl, "# ")), (1003, "m/x.c", "code"), (1004, "w/long.txt", "words " * 3000 + gpl), (1005, "w/x.c", "code")]
    files += [(2000 + k, f"z/{k}.c", "other words") for k in range(200)]
    got = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert [(got[k].license, got[k].line) for k in range(len(L.TEMPLATES))] == [(name, 1) for name, _ in L.TEMPLATES]
    assert all(got[k].similarity > 0.99 for k in (*range(len(L.TEMPLATES)), 1000, 1002))
    assert [(got[k].effective, got[k].licensed_by) for k in (1001, 1003, 1005)] == [("GPL-3.0", "g"), ("GPL-3.0", "m"), (None, None)]


def test_whole_files_within_the_bound(spark):
    """Texts of licence files mixed with other words: those with a cosine above the threshold give their licence to their directory."""
    rng, mit = random.Random(4), next(text for name, text in L.TEMPLATES if name == "MIT" and "sublicense" in text)
    files = [(k, f"d{k}/readme", mit + "\n" + " ".join(f"x{rng.randrange(10**6)}" for _ in range(4 * k))) for k in range(30)] + [(100 + k, f"d{k}/code.c", "code") for k in range(30)]
    files += [(200 + k, "z.c", "other words") for k in range(100)]
    got = {r.doc_id: r.effective for r in L.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    tok = lambda s: Counter(re.findall(L._TOKEN, s.lower()))
    df, n = Counter(t for _, _, text in files for t in tok(text)), len(files)
    vocabulary = {t for _, text in L.TEMPLATES for t in tok(text)}
    weight = lambda t: math.log((1 + n) / (1 + (df[t] if t in vocabulary else 1))) + 1
    vector = lambda c: {t: (1 + math.log(k)) * weight(t) for t, k in c.items()}
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for k, _, text in files[:30]:
        v = vector(tok(text))
        want[100 + k] = any(sum(v.get(t, 0) * x for t, x in w.items()) / size(v) / size(w) >= L.THRESHOLD for w in (vector(tok(t)) for _, t in L.TEMPLATES))
    assert {k: got[k] is not None for k in want} == want and 0 < sum(want.values()) < 30


def test_a_long_file_of_lines_that_matter(spark):
    """Three thousand lines that each hold a token of some header: the same best header as by brute force on the part that holds it, and no row with all of them several times."""
    rng = random.Random(8)
    words = "released under the mit license licensed apache version 2.0 gnu general public work this is code".split()
    noise = [" ".join(rng.choice(words) for _ in range(3)) + f" word{k} some other text that goes on" for k in range(3000)]
    text = "\n".join([*noise[:1500], "This work is licensed under the", "GNU General Public License, version 3.", *noise[1500:]])
    files = [(1, "a/b.txt", text), (2, "a/c.txt", "Released under the MIT License.")]
    got = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert (got[1].license, got[1].line) == ("GPL-3.0", 1500) and got[1].similarity > 0.99 and got[2].license == "MIT"
