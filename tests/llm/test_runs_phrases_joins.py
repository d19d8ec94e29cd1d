"""Periodic runs, collocations and the n-gram join against plain Python and SQL, and the cases that each must bear."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import collocations, jaccard_join, periodic_runs, queries

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{i % 700}" for i in range(30_000))
ODD = [None, "", " \t\n", "a", "A b", "a b c d", "a b c d", "a  b\nc", "éü ß", "aB.c;D e" * 40, "x " * 500, LONG, LONG.upper(), "long" * 20_000, "\x1c a \x85 b"]


def odd_rows():
    rows = [(i, t, random.Random(i).choice(["en", "de", None]), None, None) for i, t in enumerate(ODD)]
    return [*rows, rows[4], rows[4], (None, "null id here", "en", "s1", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{small}/documents.parquet'")
    return con


def same_rows(frame, sql):
    key = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].itertuples(index=False))
    return key(frame) == key(sql)


def plain_runs(words, least, times):
    """Every maximal stretch of each period, kept where no smaller period fits it."""
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        k = 0
        while k < n - q:
            start = k
            while k < n - q and words[k] == words[k + q]:
                k += 1
            length = k - start + q
            if k > start and length >= max(least, times * q):
                part = words[start : start + length]
                if not any(all(part[i] == part[i + p] for i in range(length - p)) for p in range(1, q)):
                    found.append((start, length, q))
            k += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


texts_of_few_words = st.lists(st.lists(st.sampled_from("ab"), max_size=60) | st.lists(st.sampled_from("abcdefgh"), max_size=60), min_size=1, max_size=6)


@given(texts_of_few_words, st.sampled_from([(4, 2), (6, 3), (24, 3)]))
@settings(max_examples=150, deadline=None)
def test_runs_by_refinement(texts, rule):
    for words, (got_words, runs) in zip(texts, periodic_runs.find_runs([" ".join(w) for w in texts], *rule)):
        assert [w.decode() for w in got_words] == words and runs == plain_runs(words, *rule)


def test_runs_touch_positions_n_log_n_times():
    # the small parts of one text of 2**14 words in 8 periods hold no more than n log2 n positions in all
    n, touched = 1 << 14, 0
    words = [str(i % 2048) for i in range(n)]
    codes = np.append(np.unique(words, return_inverse=True)[1], 1 << 20)
    begins = np.zeros(n + 1, bool)
    begins[0] = True
    part, small = periodic_runs.Partition(codes, begins), np.arange(n + 1, dtype=np.int32)
    while len(small):
        touched += len(small)
        small, _ = part.refine(small)
    assert touched <= 15 * n and (part.size[part.of] == 1).all()


def test_run_query(spark, small):
    got = {r.doc_id: r for r in queries.op11_partition_refinement_runs(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and sum(r.n_runs > 0 for r in got.values()) > 5
    for doc_id, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 1_500:
            continue  # the plain form is quadratic
        runs, row = plain_runs(words, 24, 3), got[doc_id]
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()


def plain_collocations(rows, least, k):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, 6):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        often = {g: a for g, a in f.items() if a >= least}
        inner = defaultdict(int)
        for g, a in often.items():
            for n in range(2, len(g)):
                for i in range(len(g) - n + 1):
                    inner[g[i : i + n]] = max(inner[g[i : i + n]], a)
        found = []
        for g, a in often.items():
            if len(g) > 1 and inner[g] < a:
                score, cut = min((1000 * a * totals[lang] // (f[g[:c]] * f[g[c:]]), c) for c in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), f[g[:cut]], f[g[cut:]]))
        out += [(lang, r + 1, g.decode(), -a, x, y, totals[lang], -score) for r, (score, a, g, x, y) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.mark.parametrize("bound", [300_000, 20])
def test_collocations(spark, small, bound):
    # words beyond a small dictionary are numbered by a join
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = plain_collocations(docs.select("lang", "text").collect(), 8, 150)
    got = collocations.collocations(docs, least=8, k=150, max_broadcast_words=bound).collect()
    assert len(want) > 100 and sorted(map(tuple, got)) == want


def test_collocations_exact_beyond_64_bits(spark):
    a, total = 4_000_000_007, 9_000_000_000_000_000_011
    row = spark.range(1).selectExpr(f"cast({a} as decimal(19,0)) a", f"cast({total} as decimal(19,0)) n", "cast(7 as decimal(38,0)) below")
    got = row.selectExpr("cast(cast(a * n as decimal(38,0)) * cast(1000 as decimal(4,0)) as decimal(38,0)) div cast(1000000000000000 as decimal(38,0)) as q").first().q
    assert got == a * total * 1000 // 10**15


def test_radix_sort_and_run_lengths():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 3, (5_000, 6), dtype=np.uint8)
    got, n = collocations.run_lengths(keys)
    want = Counter(map(bytes, keys))
    assert [bytes(k) for k in got] == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]


def test_join_query_and_sql(spark, small, duck):
    assert same_rows(queries.op13_signature_tree_join(spark, small).toPandas(), duck.sql(queries.OP13_SQL).df())


def plain_components(texts, percent=85):
    sets = []
    for t in texts:
        w = re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = up(i), up(j)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [up(i) for i in range(len(texts))]


def test_join_in_many_blocks(spark, monkeypatch):
    """One group of near copies over many blocks, with chains and outsiders of every size; links between blocks are not lost."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 7)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    texts = []
    for i in range(150):
        words = base[: rng.randrange(60, 161)] if i % 3 else list(base)
        for _ in range(rng.choice([0, 1, 2, 4])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(base[:k]) for k in range(20, 160, 3)]
    got = jaccard_join.ngram_components(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")).collect()
    sizes, roots = plain_components(texts)
    assert len(set(roots)) > 3
    assert [(r.n_shingles, r.component_id) for r in sorted(got, key=lambda r: r.doc_id)] == list(zip(sizes, roots))


@given(st.lists(st.lists(st.sampled_from("abcdefghijkl"), max_size=40), min_size=2, max_size=25), st.sampled_from([50, 85, 100]))
@settings(max_examples=100, deadline=None)
def test_signature_tree(texts, percent):
    sets = list({s.tobytes(): s for s in (jaccard_join.grams(" ".join(t), 2) for t in texts) if len(s)}.values())
    if not sets:
        return
    pairs = {(i, j) for i in range(len(sets)) for j in range(i) if (lambda o: 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o))(len(np.intersect1d(sets[i], sets[j])))}
    found = list(jaccard_join.SignatureTree(sets, percent, np.arange(len(sets))).links())
    assert all((max(p), min(p)) in pairs for p in found)

    def groups(links):
        root = {i: i for i in range(len(sets))}
        for a, b in links:
            old, new = root[a], root[b]
            root = {k: new if r == old else r for k, r in root.items()}
        by = defaultdict(list)
        for k, r in root.items():
            by[r].append(k)
        return sorted(by.values())

    assert groups(found) == groups(pairs) and len(found) == len(sets) - len(groups(pairs))


@pytest.mark.parametrize("percent", [50, 85, 100])
@pytest.mark.parametrize("n", [1, 2, 3, 6, 7, 20, 101])
def test_prefix_length_meets_every_link(n, percent):
    # a set of n may lack n - ceil(percent n) n-grams of a link at most, so one more always meets it
    need = -(-percent * n // 100)
    assert jaccard_join.prefix_length(n, percent) == n - need + 1


RUNS = {"runs": periodic_runs.periodic_runs, "planted": periodic_runs.with_planted_runs, "join": jaccard_join.ngram_components}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(spark, odd, name):
    clash = odd.selectExpr("*", "1 as n", "2 as digest", "3 as runs", "4 as unit", "5 as block", "6 as `group`", "7 as key", "8 as component_id", "9 as hashes", "10 as owner")
    got = RUNS[name](clash).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows())
    empty = RUNS[name](spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.dtypes == RUNS[name](odd).dtypes


def test_odd_rows_of_the_join(odd):
    got = {r.doc_id: r for r in jaccard_join.ngram_components(odd.where("doc_id is not null")).collect()}
    assert [got[i].n_shingles for i in (0, 1, 2, 3, 4)] == [0, 0, 0, 1, 1]
    assert [got[i].component_id for i in (0, 1, 2, 6, 11, 12)] == [0, 1, 2, 5, 11, 11]


def test_odd_rows_of_collocations(spark, odd):
    clash = odd.selectExpr("*", "1 as n", "2 as word", "3 as key", "4 as total", "5 as ids", "6 as `rank`", "7 as phrase", "8 as number")
    got = collocations.collocations(clash, least=2).collect()
    assert {r.lang for r in got} <= {"en", "de", "und"} and got
    empty = collocations.collocations(spark.createDataFrame([], DOCS))
    assert empty.count() == 0 and empty.dtypes == collocations.collocations(odd).dtypes


def test_sets_of_many_slices_are_kept_once(spark, monkeypatch):
    """Copies of two near texts in many tasks: of the sets that met each is stored once."""
    from graphloom.llm import jaccard_join as joins

    kept = []
    monkeypatch.setattr(joins, "written", lambda df, plain=joins.written: kept.append((df.columns, (out := plain(df)).count())) or out)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words, "end"] if i % 2 else words)) for i in range(12)], "doc_id bigint, text string").repartition(6, "doc_id")
    assert {r.component_id for r in joins.ngram_components(docs).collect()} == {0}
    assert [n for columns, n in kept if columns == ["digest", "owner", "n", "hashes"]] == [2]
