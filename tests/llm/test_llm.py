"""Operators of the llm folder, on small cases against brute force, round trips and counts."""

from __future__ import annotations

import random
import time
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, same_rows
from tests.llm import held_out
from tidemark.llm import encode, nearest, packing, pii, queries, queries_sql


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    ours = queries.QUERIES[name](spark, small)
    if name in queries_sql.SQL:
        same_rows(ours.toPandas(), connect(small).execute(queries_sql.SQL[name]).fetchdf())
    else:
        assert ours.count() > 0


# --- nearest time -------------------------------------------------------------------------


@pytest.mark.parametrize("part_rows", [9, 500_000])
@pytest.mark.parametrize("span", [2, 5, 32])
def test_nearest(spark, span, part_rows):
    r = random.Random(span)
    left = [(i, r.choice(["usd", " USD ", "EUR", None, "GBP"]), r.choice([None, *range(-300, 1500)])) for i in range(400)]
    right = [(i, r.choice(["USD", "eur", None]), r.choice([None, *range(-300, 1500)]), r.choice([None, 1.0, 2.0])) for i in range(150)]
    right += [(i + 1000, *right[i][1:]) for i in range(30)]
    a = spark.createDataFrame(left, "id long, k string, at long").withColumn("part", F.lit("clash"))
    b = spark.createDataFrame(right, "rid long, k string, t long, v double").withColumn("id", F.lit(0))
    args = dict(left_id="id", left_key="k", left_ms="at", right_id="rid", right_key="k", right_ms="t", right_value="v", tolerance_ms=20, span=span, part_rows=part_rows)
    got = {tuple(x) for x in nearest.match_nearest(a, b, **args).collect()}
    want = set()
    for i, k, at in left:
        near = [(abs(t - at), t, n) for n, kk, t, v in right if None not in (k, kk, at, t, v) and k.strip().upper() == kk.strip().upper() and abs(t - at) <= 20]
        if near:
            want.add((i, min(near)[2]))
    assert got == want
    assert nearest.match_nearest(a.union(a), b, **args).count() == 2 * len(want)
    assert nearest.match_nearest(a.limit(0), b, **args).count() == nearest.match_nearest(a, b.limit(0), **args).count() == 0


# --- encoding -----------------------------------------------------------------------------

TEXTS = ["", "a", "  spaced   out \n\n\t text ", "it's we'll  I'D", "<|endoftext|> is text", "żółć 漢字 かな 🛶👩‍🚀 é", "x" * 500, " " * 300, "1234567890" * 40, "a  b " * 200 + "\r\n" * 30]


def long_text(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(["word ", "Don't ", "  ", "\n\n", "漢字", "12345 ", "...", "é", " x" * 3, "🛶 ", "a" * 7, "\t"]) for _ in range(n))


@pytest.mark.parametrize("text", [*TEXTS, long_text(1, 3000)])
def test_round_trip(text):
    ids = encode.encode_text(text)
    assert encode.decode_ids(ids) == text
    assert ids or not text


@pytest.mark.parametrize("size,overlap", [(64, 16), (100, 40), (500, 64), (37, 37)])
def test_chunks_give_the_ids_of_the_whole(size, overlap):
    for text in [*TEXTS, *(long_text(i, 400) for i in range(25))]:
        parts = [(a, *encode.encode_chunk(a, c, end, size, overlap, encode.VOCABULARY)) for a, c, end in encode.cut_chunks(text, size, overlap)]
        got = encode.stitch(parts) if text else []
        assert got is None or got == encode.encode_text(text)
    text = "plain words " * 400
    assert encode.stitch([(a, *encode.encode_chunk(a, c, end, size, overlap, encode.VOCABULARY)) for a, c, end in encode.cut_chunks(text, size, overlap)]) == encode.encode_text(text)


def test_long_text_without_ascii_is_stitched():
    r = random.Random(6)
    text = "".join(r.choice(["漢字", "かな", "。", "、", "市場", "жила", "４２", "“é”"]) for _ in range(900))
    parts = [(a, *encode.encode_chunk(a, c, end, 300, 64, encode.VOCABULARY)) for a, c, end in encode.cut_chunks(text, 300, 64)]
    assert len(parts) > 5 and encode.stitch(parts) == encode.encode_text(text)


def test_encode(spark):
    texts = [None, *TEXTS, long_text(3, 2000), "word " * 300, "y" * 5000 + " end"]
    rows = [(i % 14, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, body string").withColumn("text", F.lit("clash")).withColumn("ids", F.lit(1))
    for chunk in (300, 1 << 16):
        got = encode.encode(df, "id", "body", chunk_chars=chunk, overlap_chars=64)
        assert got.columns == ["id", "ids"]
        assert sorted((x.id, x.ids) for x in got.collect()) == sorted((i, encode.encode_text(t)) for i, t in rows)
        counted = encode.encode(df, "id", "body", count_only=True, chunk_chars=chunk, overlap_chars=64)
        assert sorted(map(tuple, counted.collect())) == sorted((i, len(encode.encode_text(t))) for i, t in rows)
    assert encode.encode(df.limit(0), "id", "body").count() == 0


def test_same_ids_as_the_other_library(spark, small):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    ours = {x.doc_id: x.ids for x in queries.p8_ids(spark, small).collect()}
    assert {d.doc_id: t.encode(d.text or "", add_special_tokens=False).ids for d in docs} == ours


# --- containers ---------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    r = random.Random(seed)
    capacity = r.choice([64, 256, 2048])
    counts: dict[int, int] = {}
    for _ in range(r.choice([1, 40, 4000])):
        s = min(capacity, max(1, int(r.choice([r.expovariate(8 / capacity), r.uniform(1, capacity), capacity * 0.51]))))
        counts[s] = counts.get(s, 0) + 1
    plan = packing.plan_containers(counts, capacity)
    packed: dict[int, int] = {}
    for c in plan:
        assert sum(s * k for s, k in c.content.items()) == capacity - c.free >= 1 and c.free >= 0
        for s, k in c.content.items():
            packed[s] = packed.get(s, 0) + k * c.n
    assert packed == counts
    assert packing.plan_containers({}, capacity) == []


def test_plan_is_close_to_the_bound():
    r = random.Random(2)
    counts: dict[int, int] = {}
    for _ in range(200_000):
        s = min(2048, max(1, int(r.lognormvariate(5.2, 0.9))))
        counts[s] = counts.get(s, 0) + 1
    used = sum(c.n for c in packing.plan_containers(counts))
    assert used <= 1.002 * sum(s * n for s, n in counts.items()) / 2048


def test_pack(spark):
    r = random.Random(1)
    rows = [(i % 900, r.choice([None, 0, 1, 7, 60, 100, 101, 350, r.randint(1, 400)])) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, n int").withColumn("part", F.lit("clash"))
    got = packing.pack(df, "id", "n", capacity=100, shares=3).toPandas()
    assert got.groupby("container")["tokens"].sum().max() <= 100
    want: dict[int, int] = {}
    for i, n in rows:
        if n:
            want[i] = want.get(i, 0) + n
    assert got.groupby("id")["tokens"].sum().to_dict() == want
    assert len(got) == sum(-(-n // 100) for _, n in rows if n)
    assert sorted(got["container"].unique()) == list(range(got["container"].nunique()))
    assert packing.pack(df.limit(0), "id", "n").count() == 0


# --- personal information -----------------------------------------------------------------

CASES = [
    ("write to ruth.orl+list@mail.example and wait", "email", "ruth.orl+list@mail.example"),
    ("mail RUTH (at) post (dot) quil (dot) test now", "email", "RUTH (at) post (dot) quil (dot) test"),
    ("mail office AT quiet-notes DOT example or", "email", "office AT quiet-notes DOT example"),
    ("mail office＠saffron.invalid.", "email", "office＠saffron.invalid"),
    ("mail a_b @ velvet.example.", "email", "a_b @ velvet.example"),
    ("call +44 (0)7700 900479 after six", "phone", "+44 (0)7700 900479"),
    ("call (416) 555-0142 after six", "phone", "(416) 555-0142"),
    ("tel:(030) 23125-372 | mail", "phone", "(030) 23125-372"),
    ("au 01.99.00.37.74 ou", "phone", "01.99.00.37.74"),
    ("on a note by the phone (07700 900552).", "phone", "07700 900552"),
    ("Applicant: Peter Berg, SSN 666-20-2771.", "id_number", "666-20-2771"),
    ("Passport QQ 98 36 43 B was handed in", "id_number", "QQ 98 36 43 B"),
    ("El DNI 00036834-D pertenece", "id_number", "00036834-D"),
    ("moved to Flat 5, 76 Harrow Road, Kalmwick QX7 1ZZ last May", "address", "Flat 5, 76 Harrow Road, Kalmwick QX7 1ZZ"),
    ("forms to 16 Harrow Blvd #8, Thornwater, ZZ 00284, attention", "address", "16 Harrow Blvd #8, Thornwater, ZZ 00284"),
    ("moved to 110 Harrow Road\nOmbreora VX18 7ZZ last", "address", "110 Harrow Road\nOmbreora VX18 7ZZ"),
    ("moved to 137 harrow avenue, brackville last Aug.", "address", "137 harrow avenue, brackville"),
    ("Anschrift: Hagelsteigstr. 147 b, 00331 Thornville\nIm", "address", "Hagelsteigstr. 147 b, 00331 Thornville"),
    ("Adresse : 31 bis rue des Hirondelles Grises, 00432 Wystham L'air", "address", "31 bis rue des Hirondelles Grises, 00432 Wystham"),
    ("Dirección: Calle del Pozo Azul, 112, 00958 Brackstadt\nEl", "address", "Calle del Pozo Azul, 112, 00958 Brackstadt"),
    ("According to Ngozi Berg-Nilsen, nothing was", "name", "Ngozi Berg-Nilsen"),
    ("Thanks to Mrs Helen J. Nilsen and others", "name", "Helen J. Nilsen"),
    ("Contactez Nilsen, Edith au 01", "name", "Nilsen, Edith"),
    ("Contactez M. Nilsen au 01", "name", "M. Nilsen"),
    ("ask for Lucy van Nilsen.", "name", "Lucy van Nilsen"),
    ("VICTOR NILSEN told the council", "name", "VICTOR NILSEN"),
]
DECOYS = """Order no. 443-21-8876 ships with batch 2857. Tracking code 12 0000 328 9988 expired. Ref 032 2812 5913, not a hotline.
Part QX-21-12 34 56 fits model 203. ISBN 978-0-00-301241-5. Meter reading 0423 365, previous 034 121. Coordinates 51.4827, -0.2828; elevation 516 m.
Martin waved from the ferry, Anna did not. Copperbeech Hall and Saffron Court won the 207 prize. Marlow Street Foods opens at 16:32 on Monday Market days.
Old Kiln Lane is closed between 22:53 and noon. Lantern Bridge Road Works, phase 3. user@ and @domain are only halves. Follow @quietkettle for updates.
The recipe yields 7 jars @ 44 each. Version 3.2.56.0 replaces 2.40.4.1. Dial 2422 inside the building. Velvet Ridge beat Port Quillan 14–51."""


@pytest.fixture(scope="module")
def corpus(spark):
    """Each case in many texts, so that the labelers' reliabilities can be estimated."""
    texts = [f"Some words come first. {t}\nMore words." for t, _, _ in CASES] * 8 + [DECOYS] * 20
    return spark.createDataFrame(list(enumerate(texts)), "id long, body string").withColumn("kind", F.lit("clash"))


def test_found(corpus):
    got: dict[int, set] = {}
    for x in pii.find(corpus, "id", "body").collect():
        got.setdefault(x.id, set()).add((x.kind, x.found_text))
    for i, (text, kind, item) in enumerate(CASES):
        assert (kind, item) in got.get(i, set()), (text, got.get(i))
    for i in range(len(CASES) * 8, len(CASES) * 8 + 20):
        assert i not in got, got.get(i)


def test_redacted(corpus, spark):
    got = {x.id: x.body for x in pii.redact(corpus, "id", "body").collect()}
    for i, (text, kind, item) in enumerate(CASES):
        assert item not in got[i] and pii.PLACEHOLDER[kind] in got[i], (text, got[i])
        assert got[i].startswith("Some words come first. ") and got[i].endswith("\nMore words.")
    assert got[len(CASES) * 8] == DECOYS


def test_odd_texts(spark):
    odd = [None, "", "   ", "a" * 100_000, "A. " * 20_000, "1" * 50_000, "(" * 5000, "Ada " * 5000, "�?@" * 2000, "x@y." * 5000, "0 " * 20_000]
    df = spark.createDataFrame(list(enumerate(odd)), "id long, body string")
    assert pii.find(df, "id", "body").count() >= 0
    out = {x.id: x.body for x in pii.redact(df, "id", "body").collect()}
    assert [out[i] for i in range(4)] == odd[:4] and len(out) == len(odd)
    assert pii.find(df.limit(0), "id", "body").count() == 0


# Names that stand in no list of the module, and family names that are also words or given names.
OUTSIDE = [
    ("Thanks to Mrs Gillian Cooper and others", "Gillian Cooper"),
    ("Applicant: Siobhan Kelly, SSN 666-20-2771.", "Siobhan Kelly"),
    ("Contactez Cooper, Gillian au 01", "Cooper, Gillian"),
    ("It was late. Desmond Murphy told the council", "Desmond Murphy"),
    ("attention Roisin Walsh, who waits", "Roisin Walsh"),
    ("Thanks to Mrs Anna Hall and others", "Anna Hall"),
    ("Frau Renate West wohnt jetzt", "Renate West"),
    ("Contactez J. Martin au 01", "J. Martin"),
    ("You can reach Martin, Anna at noon", "Martin, Anna"),
]


@pytest.mark.parametrize("text,name", OUTSIDE)
def test_every_pair_is_proposed(text, name):
    assert name in {text[a:b] for a, b, k, _ in pii.candidates(text) if pii.KINDS[k] == "name"}


def test_names_outside_the_lists(spark, small):
    """Found by what stands around them, though the names of the corpus are in the lists."""
    model = pii.train(pii.propose(spark.read.parquet(f"{small}/documents.parquet"), "doc_id", "text"))
    for text, name in OUTSIDE:
        assert [text[a:b] for a, b, k in pii.choose(pii.candidates(text), model) if pii.KINDS[k] == "name"] == [name], text
    assert not [DECOYS[a:b] for a, b, k in pii.choose(pii.candidates(DECOYS), model) if pii.KINDS[k] == "name"]


def test_votes_round_trip():
    for votes in [(1, 0, -1, 1, 1, 0), (0,) * 6, (-1,) * 6]:
        assert pii.decode_votes(pii.encode_votes(votes)) == votes


def test_only_this_folder_uses_it():
    from pathlib import Path

    root = Path(pii.__file__).resolve().parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tidemark.llm" not in p.read_text(), p


def test_held_out_sentences():
    """Recall and precision on sentences whose names and addresses stand in no list, by the model of another corpus."""
    known = {pii.plain(g) for g in pii.GIVEN_NAMES}
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist() if t]
    counts = Counter((k, v) for t in texts for _, _, k, v in pii.candidates(t))
    model = pii.fit([(k, v, n) for (k, v), n in counts.items()])
    true, hit, wrong = Counter(), Counter(), 0
    sentences = held_out.sentences()
    assert len(sentences) >= 200
    for text, items in sentences:
        got = [(pii.KINDS[k], text[a:b]) for a, b, k in pii.choose(pii.candidates(text), model)]
        for kind, item in items:
            assert kind != "name" or pii.plain(item.split(" ")[0]) not in known
            true[kind] += 1
            hit[kind] += (kind, item) in got
        wrong += len(set(got) - set(items))
    assert sum(hit.values()) >= 0.9 * sum(true.values()) and all(hit[k] >= 0.9 * true[k] for k in pii.KINDS)
    assert wrong <= 0.05 * sum(hit.values())


def test_choice_is_what_pairwise_comparison_gives():
    r = random.Random(11)
    model = pii.SpanClassifier({(k, (v,) * 6): p for k in range(5) for v, p in ((-1, 0.3), (0, 0.7), (1, 0.9))}, ())
    for _ in range(200):
        spans = [(a, a + r.randint(1, 9), r.randrange(5), (r.choice((-1, 0, 1)),) * 6) for a in (r.randrange(60) for _ in range(r.randrange(25)))]
        good = [(a, b, k, model(k, v)) for a, b, k, v in spans if model(k, v) > pii.ACCEPT]
        apart, kept = [], []
        for s in sorted((s for s in good if s[2] == 4), key=lambda s: (-s[3], -(s[1] - s[0]), s[0])):
            apart += [] if any(s[0] < x[1] and x[0] < s[1] for x in apart) else [s]
        for s in sorted([s for s in good if s[2] != 4] + apart, key=lambda s: (-(s[1] - s[0]), -s[3], s[0], s[2])):
            kept += [] if any(s[0] < x[1] and x[0] < s[1] for x in kept) else [s]
        assert pii.choose(spans, model) == sorted(s[:3] for s in kept)


def test_long_texts_cost_their_length():
    """Many items, garbled text without blanks, and runs of one character: twice the text takes about twice the time."""
    model = pii.fit([])
    one = {
        "items": "Call +44 20 7946 0321 or write to a.b@mail.example, Mrs Ada Berg. ",
        "garbled": "Ã¤Â¸Â­Ã¦â€“â€¡Ã¥Â­â€”",
        "decoded twice": "Ð¾Ð±Ð°Ñ€Ð¸Ð·Ñ‹ÑˆÐµÑŽÐ½Ð°ÐµÐ½ÑŒÑ�Ñ‚ÑƒÑˆÐµâ€¦Ã¢â‚¬Å“",
        "capitals": "A",
        "digits": "7",
        "marks": "�",
        "dots": "a.",
    }
    for name, text in one.items():
        took = []
        for n in (60_000, 240_000):
            began = time.perf_counter()
            x = text * (n // len(text))
            pii.choose(pii.candidates(x), model)
            took.append(time.perf_counter() - began)
        assert took[1] < 10 * took[0] + 0.3, (name, took)
