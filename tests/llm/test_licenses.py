import random
import re
from collections import Counter

from pyspark.sql import functions as F

from strandloom.llm import licenses
from strandloom.llm.license_texts import BASE_PHRASES, TEMPLATES
from strandloom.llm.licenses import Index, scan_licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for phrase, label in BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = [None, "", "MIT License", "mit mit license licensed cc-by cc by BY cc", "GNU General\nPublic (License) gnu general public licence", "apache license apache license", "cc by 4.0 É license mit", "x " * 400_000 + "mit license", "gnu " * 50 + "general public license"]


def test_base_places_match_brute_force(spark):
    docs = spark.createDataFrame([(i % 8, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = sorted((tuple(r)[1:6] for r in scan_licenses(docs).collect()), key=repr)
    assert got == sorted(map(brute, TEXTS), key=repr)
    assert scan_licenses(docs.limit(0)).collect() == []


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    for d in docs.select("doc_id", "text").collect():
        r = got[d.doc_id]
        assert tuple(r)[1:6] == brute(d.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert (r.score > 0) == bool(r.labels) and 0 <= r.score <= 1
        assert not r.n_base or r.score == 1


def every_start(index, text):
    """Labels and best scores of the longer templates, each tried at every place of the text."""
    words, out = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text)), {}
    words = [w.encode() for w in words]
    for n, t in enumerate(index.templates):
        best = 0.0 if t.base else max((index.score(n, s, words) for s in range(-licenses.DRIFT, len(words))), default=0.0)
        if best:
            out[t.label] = max(out.get(t.label, 0.0), best)
    for label in filter(None, brute(text)[4].split(",")):
        out[label] = 1.0
    return out


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def test_words_in_order():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(1, 70))] for _ in "ab")
        assert licenses.in_order(tuple(a), b) == subsequence(a, b)


def test_labels_and_scores_match_every_start():
    """Templates with words changed, added and dropped, several in a text, and words of theirs elsewhere, against trying every start."""
    rng, index = random.Random(5), Index({b"the": 90, b"of": 80, b"software": 20, b"license": 30}, 100)
    vocabulary = sorted({w for _, text, _ in TEMPLATES for w in text.split()})
    seen = Counter()
    for turn in range(160):
        text = []
        for _ in range(rng.randint(1, 2)):
            words = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 1, 2, 5, len(words) // 8, len(words) // 4])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1])] = rng.choice([[], ["word"], [rng.choice(vocabulary)]])
            text += ["filler"] * rng.randint(0, 40) + words + [rng.choice(vocabulary) for _ in range(rng.randint(0, 9))]
        text = " ".join(text).title()
        got, want = index.scan(text.encode()).found, every_start(index, text)
        assert got.keys() == want.keys(), (turn, got, want)
        assert all(abs(got[k] - want[k]) < 0.03 for k in want)
        seen["labels"] += len(want)
        seen["partial"] += sum(v < 1 for v in want.values())
    assert seen["labels"] > 60 and seen["partial"] > 30


def test_templates_are_found_with_slips_and_not_without_key_phrases():
    index = Index({}, 0)
    for label, text, keys in TEMPLATES:
        assert index.scan(f"before {text} after".title().encode()).found[label] == 1
        first = keys[0].split()[0]
        assert label not in {k for k, v in index.scan(text.replace(first, "qq").encode()).found.items() if v < 1}
        words = text.split()
        for change in (words[: len(words) // 2] + words[len(words) // 2 + 1 :], words[: len(words) // 2] + ["added", "here"] + words[len(words) // 2 :]):
            if all(k in " ".join(change) for k in keys):
                assert index.scan(" ".join(change).encode()).found.get(label, 0) >= 0.8
    words = TEMPLATES[1][1].split()
    words[words.index("copy")] = "version"
    assert 0.8 < index.scan(" ".join(words).encode()).found["mit"] < 1


def test_templates_are_a_parameter(spark):
    docs = spark.createDataFrame([(1, "so you may paint this fence in any colour but blue and only blue, you may paint")], "doc_id long, text string")
    table = [("fence", "you may paint this fence in any colour but blue", ["any colour"])]
    assert [(r.labels, r.score) for r in scan_licenses(docs, table).collect()] == [("fence", 1.0)]


def test_parts_lose_nothing(monkeypatch):
    text = ("filler words here " * 7 + "mit license ") * 40 + TEMPLATES[6][1]
    whole = Index({}, 0).scan(text.encode())
    monkeypatch.setattr(licenses, "PIECE_BYTES", 50)
    parts = Index({}, 0).scan(text.encode())
    assert sorted(whole.base) == sorted(parts.base) and whole.n_words == parts.n_words and whole.found == parts.found and len(whole.base) == 40
