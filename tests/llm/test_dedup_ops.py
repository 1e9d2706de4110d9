"""Exact, near and line dedup against brute force."""

import hashlib
import re

import numpy as np
import pytest
from messy import empty, messy, rows, words
from pyspark.sql import functions as F

from tagloom.llm.exact_dedup import exact_dedup, keep_first, merge_runs
from tagloom.llm.line_chunks import cut_lines, remove_repeats, without
from tagloom.llm.minhash import components, keep_one_of_each, marks, near_components, shingle_set, signature


def _norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("options", [{}, {"fan_in": 2, "run_rows": 2, "min_buckets": 2}, {"digest_bytes": 1, "min_buckets": 4}])
def test_exact_dedup_of_messy_rows(spark, options):
    got = exact_dedup(messy(spark), **options).collect()
    assert len(got) == len(rows())
    groups = {}
    for r in rows():
        groups.setdefault(_norm(r[1]), []).append(r[0])
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        known = [i for i in ids if i is not None]
        # a weakened digest is told as it is, so its groups are found by their ids
        mine = [g for g in got if g.text_sha256 == sha] if options.get("digest_bytes", 32) == 32 else None
        if mine is None:
            continue
        assert sorted(map(str, ids)) == sorted(str(g.doc_id) for g in mine)
        assert {g.keep_id for g in mine} == {min(known) if known else None}
        assert {g.group_size for g in mine} == {len(ids)}
        assert sum(g.kept for g in mine) == 1
    assert sum(g.kept for g in got) == len(groups)


def test_exact_dedup_stage_and_empty_table(spark):
    kept = keep_first(messy(spark))
    assert kept.columns == messy(spark).columns
    assert sorted(_norm(r.text) for r in kept.collect()) == sorted({_norm(r[1]) for r in rows()})
    assert exact_dedup(empty(spark)).count() == 0
    assert keep_first(empty(spark)).count() == 0


def _workers_of_a_task(plan):
    """The most Python steps that stand between two exchanges; a task holds a worker for each of them."""
    path, most = [], 0
    for line in plan.splitlines():
        node = line.lstrip(" :+-")
        del path[(len(line) - len(node)) // 3:]
        path.append(node)
        behind = next((i for i, n in enumerate(reversed(path)) if n.startswith("Exchange")), len(path))
        most = max(most, sum("InArrow" in n.split()[0] or "InPandas" in n.split()[0] for n in path[len(path) - behind:]))
    return most


@pytest.mark.parametrize("options", [{}, {"fan_in": 2, "run_rows": 2, "min_buckets": 2}])
def test_a_task_of_exact_dedup_holds_one_worker(spark, options):
    docs = spark.createDataFrame([(i, f"text {i % 7}") for i in range(40)], "doc_id long, text string").repartition(9)
    got = exact_dedup(docs, **options)
    assert _workers_of_a_task(got._jdf.queryExecution().executedPlan().toString()) == 1
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == [
        (i, i % 7, 6 if i % 7 < 5 else 5, i < 7) for i in range(40)]


def test_merge_keeps_the_first_run_of_the_smallest_id():
    import numpy as np
    key = lambda x: np.array([x.ljust(48, b".")], "S48").tobytes()
    long = lambda *x: np.array(x, "<i8").tobytes()
    k, least, held, n = merge_runs([key(b"a") + key(b"b"), key(b"a")], [long(7, 3), long(7)], [long(0, 0), long(1)], [long(2, 1), long(4)])
    assert least.tolist() == [7, 3] and held.tolist() == [0, 0] and n.tolist() == [6, 1] and len(k) == 2


def _brute_components(table, size, percent):
    def grams(t):
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = [grams(t) for _, t in table]
    label = [i for i, _ in table]
    changed = True
    while changed:
        changed = False
        for a in range(len(table)):
            for b in range(a):
                if None in (table[a][0], table[b][0]) or not sets[a] or not sets[b] or label[a] == label[b]:
                    continue
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low, high = sorted((label[a], label[b]))
                    label = [low if x == high else x for x in label]
                    changed = True
    return [(table[i][0], len(sets[i]), label[i]) for i in range(len(table))]


@pytest.mark.parametrize("size", [4, 5])
def test_near_components_of_messy_rows(spark, size):
    table = [(r[0], r[1]) for r in rows() if r[0] != 9]  # an id with two texts is judged by row
    got = near_components(messy(spark).where("doc_id IS NULL OR doc_id <> 9"), size=size).collect()
    want = _brute_components(table, size, 80)
    assert sorted(map(str, ((g.doc_id, g.n_shingles, g.component_id) for g in got))) == sorted(map(str, want))
    assert all(g.kept == (g.doc_id is None or g.doc_id == g.component_id) for g in got)


def test_rows_of_one_id_go_or_stay_by_their_own_text(spark):
    a, b = words(2, 60), words(99, 60)
    docs = spark.createDataFrame([(8, a), (9, a), (9, b), (7, None), (None, a)], "doc_id long, text string")
    left = sorted(((r.doc_id, r.text) for r in keep_one_of_each(docs, size=5).collect()), key=repr)
    assert left == sorted([(8, a), (9, b), (7, None), (None, a)], key=repr)


def test_marks_differ_no_more_than_sets():
    numbers = np.random.default_rng(5)
    for n in (0, 1, 40, 3000):
        x = np.unique(numbers.integers(0, 2**64, n, np.uint64))
        y = np.unique(np.concatenate([x[n // 5:], numbers.integers(0, 2**64, n // 7, np.uint64)]))
        differ = sum(bin(int(v) & (2**64 - 1)).count("1") for v in marks(x) ^ marks(y))
        assert differ <= len(np.setxor1d(x, y)) and (differ > 0) == (len(np.setxor1d(x, y)) > 0)


def test_near_components_of_a_group_of_near_copies(spark):
    """Copies with edits of their own: hubs join most, the prefix filter finds what they leave."""
    import random
    draw = random.Random(5)
    base = [f"v{draw.randrange(5000)}" for _ in range(120)]
    table = []
    for i in range(150):
        own = list(base)
        for _ in range(draw.randrange(7)):
            own[draw.randrange(120)] = f"x{draw.randrange(10**6)}"
        table.append((i, " ".join(own)))
    got = near_components(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert sorted((g.doc_id, g.n_shingles, g.component_id) for g in got) == sorted(_brute_components(table, 4, 80))


def test_near_dedup_stage_and_empty_table(spark):
    left = keep_one_of_each(messy(spark), size=5)
    assert left.columns == messy(spark).columns
    assert {None, 0, 1, 14} <= {r.doc_id for r in left.collect()}
    assert near_components(empty(spark)).count() == 0


def test_signature_estimates_similarity():
    import numpy as np
    draw = np.random.default_rng(3)
    both, a, b = (draw.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    x, y = np.concatenate([both, a]), np.concatenate([both, b])
    assert abs((signature(x, 2000) == signature(y, 2000)).mean() - 0.8) < 0.04
    assert len(shingle_set(b"", 4)) == 0 and len(shingle_set(b"a b", 4)) == 1


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)]
    got = dict(components(spark, spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 40)}


def test_line_chunks_against_brute_force(spark):
    passage = "\n".join(f"shared line {i}" for i in range(30))
    table = [(i, f"own {i}\n" * (i % 3) + passage + f"\nown end {i}") for i in range(12)] + [(50, None), (51, ""), (52, "\n\n\n"), (None, passage)]
    df = spark.createDataFrame(table, "doc_id long, text string").withColumns({"_doc": F.lit(1), "_tie": F.lit(2), "digest": F.lit(3)})
    got = {r.doc_id: r for r in remove_repeats(df, "told").collect()}
    seen, want = set(), {}
    for doc, text in table:
        if text is None:
            want[doc] = (None, 0, 0)
            continue
        body, gone = text.encode(), set()
        chunks = cut_lines(body, 2, 4, 64)
        for k, (a, b, n) in enumerate(chunks):
            part = body[a:b].removesuffix(b"\n")
            if n >= 2:
                gone |= {k} if part in seen else set()
                seen.add(part)
        want[doc] = (without(body, chunks, gone).decode() if gone else text, len(chunks), len(gone))
    assert {d: (r.text, r.told.chunks, r.told.removed) for d, r in got.items()} == want
    assert sum(x[2] for x in want.values()) > 10
    assert remove_repeats(empty(spark), "told").count() == 0
    assert remove_repeats(messy(spark), "told").count() == len(rows())


def test_chunks_survive_a_shift():
    body = b"".join(b"line %d\n" % i for i in range(200))
    cut = lambda t: {t[a:b] for a, b, _ in cut_lines(t, 2, 4, 64)}
    assert len(cut(body) & cut(b"new first line\n" + body)) >= len(cut(body)) - 2


def _planted():
    """Documents of own lines around passages of 2 to 5 lines; what an earlier document holds, by brute force."""
    import random
    draw = random.Random(11)
    line = lambda n: " ".join(f"p{draw.randrange(10**6)}" for _ in range(n))
    passages = [[line(12 + draw.randrange(60)) for _ in range(2 + i % 4)] for i in range(12)]
    passages[3].insert(1, "")
    docs = []
    for i in range(40):
        body = [line(20)]
        for p in draw.sample(passages, 2):
            body += p + [line(1 + draw.randrange(30))]
        docs.append(body)
    docs += [[line(20), *docs[0][1:4]], [line(80)], [line(80)]]
    docs[-1] = docs[-2]  # one long line
    want = []
    for i, body in enumerate(docs):
        gone = set()
        for a in range(len(body)):
            for b in range(a + 1, len(body) + 1):
                run = body[a:b]
                if sum(len(x.split()) for x in run) > 50 and body[a].split() and body[b - 1].split() and any(
                        run == d[j:j + b - a] for d in docs[:i] for j in range(len(d))):
                    gone |= set(range(a, b))
        want.append("".join(x + "\n" for j, x in enumerate(body) if j not in gone))
    return [(i, "".join(x + "\n" for x in body)) for i, body in enumerate(docs)], want


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_planted_passages_go_whole(spark, digest_bytes):
    table, want = _planted()
    got = remove_repeats(spark.createDataFrame(table, "doc_id long, text string"), "told", min_lines=99, over_words=50, digest_bytes=digest_bytes).collect()
    assert [r.text for r in sorted(got)] == want
    assert sum(x.count("\n") for _, x in table) - sum(x.count("\n") for x in want) > 100
    assert all((r.told.removed == r.told.chunks) == (r.text == "") for r in got)


def test_repeats_within_a_text_stay_once(spark):
    passage = "".join(" ".join(f"v{i}x{j}" for j in range(30)) + "\n" for i in range(3))
    table = [(1, "own\n" + passage + passage + "end\n"), (2, "same line of five words\n" * 100), (3, passage.removesuffix("\n"))]
    got = {r.doc_id: r.text for r in remove_repeats(spark.createDataFrame(table, "doc_id long, text string"), "told", min_lines=99, over_words=50).collect()}
    assert got == {1: "own\n" + passage + "end\n", 2: "same line of five words\n" * 11, 3: ""}
