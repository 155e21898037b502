"""The pipeline's stages, one by one and together, against brute force, with odd rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm.test_text_operators import brute_repeats, prose, word_list

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)
ENGLISH = "the and with that would there people which about because through another between should water".split()
GERMAN = "der und nicht eine sich auch werden zwischen durch gegen während schließlich größer können müssen".split()


@pytest.fixture
def stage(spark, tmp_path):
    """stage(name, rows): what a stage keeps of rows (doc_id, text), as (doc_id, text)."""

    def run(name, rows):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
        path = str(tmp_path / f"{name}-{random.random()}")
        STAGES[name](spark, docs, str(tmp_path)).write.parquet(path)
        out = spark.read.parquet(path)
        assert name == "packing" or out.columns == corpus_pipeline.COLUMNS
        return out if name == "packing" else sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    return run


def said(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_table(stage, name):
    out = stage(name, [])
    assert (out.count() if name == "packing" else len(out)) == 0


def test_language_stage_keeps_rows_as_they_are(stage):
    rng = random.Random(1)
    rows = [(i, said(rng, ENGLISH, 40)) for i in range(60)] + [(None, said(rng, ENGLISH, 40))] * 2 + [(7, said(rng, ENGLISH, 30))] * 2
    no_language = [(900, None), (901, ""), (902, "12 34 --")]
    assert stage("language_id", rows + no_language) == sorted(rows, key=str)


def test_line_stage(stage):
    rows = [(i, f"Menu\nown {i}\n menu ") for i in range(12)] + [(None, "MENU\nkept"), (50, "menu"), (51, None), (52, "alone")]
    assert stage("line_dedup", rows) == sorted([(i, f"own {i}") for i in range(12)] + [(None, "kept"), (52, "alone")], key=str)


def near_brute(rows):
    """What stays of rows of unique ids: the least id of each component of links on five-word shingles from 0.8 on."""
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := word_list(t)) else set() for i, t in rows}
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return [(i, t) for i, t in rows if top(i) == i]


def test_near_duplicate_stage(stage):
    rng = random.Random(2)
    rows = []
    for i in range(25):
        words = prose(rng, 120, 10**6).split()
        for copy in range(rng.randrange(1, 5)):
            own = list(words)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = "changed"
            rows.append((100 * i + copy, " ".join(own)))
    rows += [(5000, "one two"), (5001, "One  two"), (5002, "three"), (5003, ""), (5004, None)]
    odd = [(None, rows[0][1])] * 2  # without id: linked with nothing
    expected = near_brute(rows)
    assert len(expected) < len(rows)
    assert stage("near_duplicates", rows + odd) == sorted(expected + odd, key=str)
    again = [rows[0]] * 3 + rows[1:]  # of repeated rows one stays
    assert stage("near_duplicates", again) == sorted(expected, key=str)


def test_passage_stage(stage):
    rng = random.Random(3)
    passage = prose(rng, 70, 10**9)
    rows = [(i, f"{prose(rng, 30, 10**9)} {passage} {prose(rng, 20, 10**9)}") for i in range(5)] + [(10, passage), (11, "short"), (None, passage)]
    cut = brute_repeats([r for r in rows if r[0] is not None], 50)
    expected = []
    for i, t in rows:
        kept = [w for at, w in enumerate(t.split()) if i is None or at not in cut.get(i, ())]
        if kept:
            expected.append((i, " ".join(kept)))
    assert [(i, t.strip()) for i, t in stage("suffix_dedup", rows)] == sorted(expected, key=str)


def test_packing_stage(stage):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(1, 900))) for i in range(20)] + [(None, "no id"), (30, None), (31, "")]
    found, filled = defaultdict(list), defaultdict(list)
    for r in stage("packing", rows).collect():
        found[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(found[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for parts in filled.values():
        ends = np.cumsum([0, *(n for _, n in sorted(parts))])
        assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 2048


@pytest.mark.parametrize("name", ["language_id", "line_dedup", "near_duplicates", "suffix_dedup"])
def test_very_long_text(stage, name):
    """A text of 4 MB, of some 700,000 words, passes whole."""
    rng = random.Random(5)
    long = said(rng, ENGLISH, 700_000) if name == "language_id" else prose(rng, 500_000, 10**9)
    rows = [(1, long), (2, said(rng, ENGLISH, 30)), (3, said(rng, ENGLISH, 30)), (4, said(rng, ENGLISH, 30))]
    assert stage(name, rows) == sorted(rows, key=str)


def test_run(spark, tmp_path):
    """The whole pipeline: what is packed is what the stages' definitions leave, token by token."""
    from tokenizers import Tokenizer

    rng = random.Random(6)
    passage = said(rng, ENGLISH, 80)
    rows = [(i, f"{said(rng, ENGLISH, 30)} own{i}\nnavigation bar\n{said(rng, ENGLISH, 40)} {i}") for i in range(40)]
    rows += [(100, f"{passage} first"), (101, f"{said(rng, ENGLISH, 40)} {passage} {said(rng, ENGLISH, 40)}")]
    rows += [(200, rows[3][1]), (201, rows[4][1] + " more"), (300, "12 34"), (301, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    texts = {i: t for i, t in rows if t and any(c.isalpha() for c in t)}
    lines = Counter(line for t in texts.values() for line in {x.strip().lower() for x in t.split("\n")})
    texts = {i: "\n".join(x for x in t.split("\n") if lines[x.strip().lower()] < 10) for i, t in texts.items()}
    texts = dict(near_brute(sorted(texts.items())))
    assert set(texts) == {*range(40), 100, 101}
    cut = brute_repeats(list(texts.items()), 50)
    assert list(cut) == [101] and len(cut[101]) == 80
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    head = " ".join(w for at, w in enumerate(texts[101].split()) if at not in cut[101])
    texts[101] = head
    assert {r.doc_id: r.doc_tokens for r in out} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
