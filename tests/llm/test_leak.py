import random
import subprocess
import sys

from heapline.llm import leak

DOCS, ITEMS = "doc_id bigint, text string, item_id string, start_char int", "item_id int, text string, doc_id string"


def brute(docs, items, n):
    out = set()
    for d, t in docs:
        dw = leak.words(t or "")
        for i, s in items:
            w = leak.words(s or "")
            if any(dw[a : a + n] == w[b : b + n] for a in range(len(dw) - n + 1) for b in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abcd") for _ in range(30))) for i in range(12)] + [(100, "a b c"), (101, None), (102, "")]
    docs = [(k, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 60)))) for k in range(60)] + [(200, None), (201, ""), (7, items[3][1]), (7, items[3][1])]
    ddf, idf = spark.createDataFrame([(*d, "x", 1) for d in docs], DOCS), spark.createDataFrame([(*i, "y") for i in items], ITEMS)
    for size in (1_000_000, 60):
        spec = leak.LeakSpec(min_words=6, block_words=size)
        assert {(r.doc_id, r.item_id) for r in leak.leaked_items(ddf, idf, spec).collect()} == brute(docs, items, 6)
    assert leak.leaked_items(ddf.limit(0), idf).count() == 0 and leak.leaked_items(ddf, idf.limit(0)).count() == 0


def test_normalisation_and_offsets(spark):
    item = "Die Straße führt über neun Brücken, zwei Hügel und einen Fluß bis ans Meer (K 17)."
    said = "xx: DIE STRASSE fuehrt"  # ue is no accent
    form = "vorher „DIE­ STRASSE FÜHRT über – neun\nBrücken; ｚｗｅｉ Hu​gel und einen FLUSS bis ans Meer nachher"
    ddf = spark.createDataFrame([(1, form, "x", 1), (2, said, "x", 1)], DOCS)
    idf = spark.createDataFrame([(5, item, "y")], ITEMS)
    (r,) = leak.leaked_spans(ddf, idf, leak.LeakSpec(min_words=13)).collect()
    assert (r.doc_id, r.item_id, r.n_words) == (1, 5, 14)
    assert form[r.start_char :].startswith("DIE") and form[: r.end_char].endswith("Meer")


def test_one_word_less_is_no_leak():
    a = leak.Automaton([(1, "a b c d e f g h i j k l m n")], 13)
    assert a.hits("x a b c d e f g h i j k l y") == [] and a.hits("x a b c d e f g h i j k l m y") == [(1, 1, 13)]


def test_passages_are_whole_and_each_alignment_counts():
    rng = random.Random(8)
    for n in (1, 2, 5, 6, 13):
        items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(6)]
        a = leak.Automaton(items, n)
        for _ in range(40):
            text = " ".join(rng.choice("abcx") for _ in range(rng.randint(0, 60)))
            w = text.split()
            want: dict = {}
            for i, s in items:
                v = s.split()
                ends = sorted({e for e in range(n - 1, len(w)) if any(w[e - n + 1 : e + 1] == v[k : k + n] for k in range(len(v) - n + 1))})
                for e in ends:
                    spans = want.setdefault(i, [])
                    if spans and e <= spans[-1][1] + 1:
                        spans[-1][1] = e
                    else:
                        spans.append([e - n + 1, e])
            assert sorted(a.hits(text)) == sorted((i, x, z) for i, spans in want.items() for x, z in spans)


def test_sixteen_megabytes_of_items_stay_small():
    """A block's automaton is bounded by its words; a set of 16 MB takes several blocks, of which a worker holds two."""
    code = """
import random, resource, sys
from heapline.llm import leak
rng = random.Random(1)
vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(60000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
held = [leak.Automaton([(i, " ".join(rng.choice(vocabulary) for _ in range(110))) for i in range(9000)], 13) for _ in range(2)]
assert sum(len(s) // 2 for s in held[0].seqs) == 990000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    mb = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert mb < 500, mb


def test_very_long_text(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    long = "lorem ipsum " * 200000 + passage + " dolor" * 200000
    ddf = spark.createDataFrame([(1, long, "x", 1), (2, "lorem " * 100000, "x", 1)], DOCS)
    idf = spark.createDataFrame([(5, "a b " + passage, "y")], ITEMS)
    (r,) = leak.leaked_spans(ddf, idf).collect()
    assert (r.doc_id, r.n_words) == (1, 20) and long[r.start_char : r.end_char] == passage
