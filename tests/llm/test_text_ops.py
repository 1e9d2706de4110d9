"""Language, language model, url filter, archives, decontamination."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from messy import empty, messy, rows
from pyspark.sql import functions as F

from tagloom.llm.decontaminate import FMIndex, Wavelet, drop_leaks, leak_report, merged, suffix_array
from tagloom.llm.hmm import Hmm, HmmSettings, Lattice, score_texts
from tagloom.llm.lang_id import drop_unidentified, identify, letters
from tagloom.llm.url_filter import LmSettings, url_verdicts
from tagloom.llm.warc import archive_round_trip, checked, members_from, read_warc, record_bytes, write_warc

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right, every = got.where("held_out AND lang = lang_pred").count(), got.where("held_out").count()
    assert right >= 0.98 * every
    assert got.where("rejected").count() == 0


def test_language_of_messy_rows(spark):
    got = identify(messy(spark)).collect()
    assert len(got) == len(rows())
    by_text = {}
    for g in got:
        by_text.setdefault(g.doc_id, []).append(g)
    for r in rows():
        if r[0] is not None and sum(x[0] == r[0] for x in rows()) == 1:
            g, = by_text[r[0]]
            assert (g.lang_pred == "und") == (not any(c.isalpha() for c in r[1] or ""))
            assert g.held_out == (zlib.crc32(str(r[0]).encode()) % 3 == 1) and 0 <= g.score <= 1
    assert identify(empty(spark)).count() == 0
    assert drop_unidentified(messy(spark)).columns == messy(spark).columns


def test_far_text_is_rejected(spark):
    draw = np.random.default_rng(0)
    docs = [(i, " ".join(draw.choice(["the", "and", "thing", "other", "weather"], 80)), "en") for i in range(60)]
    docs += [(100 + i, " ".join(draw.choice(["das", "ist", "schön", "nicht", "wetter"], 80)), "de") for i in range(60)]
    docs += [(1000, " ".join(draw.choice(["жук", "лиса", "ёлка"], 80)), None)]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert got[1000].rejected and not any(r.rejected for d, r in got.items() if d != 1000)


@pytest.mark.parametrize("size", [5, 80])
def test_short_far_text_is_rejected(spark, size):
    """Where labelled texts are as short, by the floor of their length; elsewhere by its letters."""
    draw = np.random.default_rng(0)
    docs = [(i, " ".join(draw.choice(["the", "and", "thing", "other", "weather"], size)), "en") for i in range(60)]
    docs += [(100 + i, " ".join(draw.choice(["das", "ist", "schön", "nicht", "wetter"], size)), "de") for i in range(60)]
    docs += [(1000, "жук лиса ёлка жук лиса ёлка", None), (1001, "the other thing", None), (1002, "nicht schön", None)]
    docs += [(1003, "aksu okka uska koak sukka", None)] if size == 5 else []
    got = {r.doc_id: r for r in identify(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert {d for d, r in got.items() if r.rejected} == {1000, 1003} & set(got)


def test_letters():
    assert bytes(letters("A1b--É").astype("uint8")).decode("latin1") == " a b é "
    assert letters("").tolist() == letters(" 1").tolist() == [32]


def _brute_likelihood(model, seen, weights):
    total = 0.0
    states = len(model.start)
    for path in np.ndindex(*[states] * len(seen)):
        p = model.start[path[0]] * weights[0][path[0]]
        for t in range(1, len(seen)):
            p *= model.move[path[t - 1], path[t]] * weights[t][path[t]]
        total += p
    return total


def test_forward_and_backward_against_all_paths():
    draw = np.random.default_rng(1)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    model = Hmm(norm(draw.random(3)), norm(draw.random((3, 3))), norm(draw.random((3, 5))).T)
    sequences = [draw.integers(0, 5, n).astype(np.int32) for n in (4, 1, 6, 4)]
    lattice = Lattice(sequences)
    weights = model.emit[lattice.by_time(lattice.flat)]
    alpha, scale = lattice.forward(model.start, model.move, weights)
    own = np.log(scale[lattice.place])
    edges = np.cumsum(lattice.lengths) - lattice.lengths
    for k, i in enumerate(lattice.order):
        told = own[edges[k]:edges[k] + lattice.lengths[k]].sum()
        assert np.isclose(np.exp(told), _brute_likelihood(model, sequences[i], model.emit[sequences[i]]))
    share, moves = lattice.backward(model.move, weights, alpha, scale)
    assert np.allclose(share.sum(axis=1), 1)
    assert np.isclose(moves.sum(), sum(len(s) - 1 for s in sequences))


def test_scores_of_messy_rows(spark):
    settings = HmmSettings(states=3, classes=64, rounds=2)
    got = score_texts(messy(spark), settings=settings).collect()
    assert len(got) == len(rows())
    tokens = lambda t: (t or "").encode().lower().split()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts: dict = {}
    for r in rows():
        if not held(r[0]):
            for w in [*tokens(r[1]), None]:
                counts[w] = counts.get(w, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), len(tokens(r[1])) + 1, sum(w in counts for w in [*tokens(r[1]), None]),
                   round(sum(np.log10((counts.get(w, 0) + 1) / (total + kinds + 1)) for w in [*tokens(r[1]), None]), 4)) for r in rows())
    assert sorted((str(g.doc_id), g.n_tokens, g.n_known, round(g.base_score, 4)) for g in got) == want
    assert all(np.isfinite(g.score) and g.score <= 0 and g.train_tokens == total for g in got)
    assert score_texts(empty(spark), settings=settings).count() == 0


def test_model_beats_the_base_on_held_out_documents(spark):
    got = score_texts(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.85 * got[1]


def _rule(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (found[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), found[2]) if found else ("", "")
    best = None
    for verdict, rule in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


URLS = [None, "", "no scheme", "http://a.com", "http://a.com/", "HTTP://WWW.Example.COM/en/x?q", "http://x.www.example.com/en/", "http://example.com/en",
        "http://example.com/en/", "http://notexample.com/en/", "http://b.net/es/#f", "http://b.net/ES/", "http://net/fr/", "x://com/", "://com/a",
        "http://h.org?x=/y", "http://a.net/fr/://c.com/", "http://ü.net/de/"] + [f"http://s{i}.com/good/{i}" for i in range(60)] + [
        f"http://s{i}.net/fr/bad{i}" for i in range(60)] + ["http://q.org/good/7", "http://q.org/fr/bad7", "http://q.org/good/7"]


def test_url_verdicts(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumns({"text": F.lit(1), "at": F.lit(2), "gram": F.lit(3)})
    got = {r.page_id: r for r in url_verdicts(pages, settings=LmSettings(cells=1 << 10)).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule = _rule(url)
        assert (got[i].host, got[i].path) == (host, path), url
        assert got[i].rule == (rule[1] if rule else None), url
        assert got[i].verdict == (rule[0] if rule else got[i].verdict) and got[i].verdict in ("allow", "block")
    n = len(URLS)
    assert got[n - 3].verdict == "allow" and got[n - 2].verdict == "block" and got[n - 1].verdict == "allow"
    assert url_verdicts(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_verdicts(pages.where("page_id < 3")).collect()} == {"allow"}


def _brute_scores(train, texts, order=4, strength=2.0, alphabet=256):
    """Log ratio per character with exact counts and contexts."""
    counts = {True: {}, False: {}}
    for text, good in train:
        for at in range(order, len(text)):
            for n in range(1, order + 2):
                gram = text[at - n + 1:at + 1]
                counts[good][gram] = counts[good].get(gram, 0) + 1
    follow = {c: {} for c in counts}
    for c, held in counts.items():
        for gram, k in held.items():
            follow[c][gram[:-1]] = follow[c].get(gram[:-1], 0) + k

    def chance(c, gram):
        low = chance(c, gram[1:]) if len(gram) > 1 else 1 / alphabet
        return (counts[c].get(gram, 0) + strength * low) / (follow[c].get(gram[:-1], 0) + strength)

    return [np.mean([np.log(chance(True, t[at - order:at + 1]) / chance(False, t[at - order:at + 1])) for at in range(order, len(t))]) for t in texts]


def test_url_scores_against_exact_counts(spark):
    """More n-grams than any fixed count of cells keeps apart; one that training lacks backs off."""
    draw = np.random.default_rng(4)
    name = lambda: "".join(draw.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 30))
    urls = [f"http://s.com/{name()}" for _ in range(900)] + [f"http://s.net/fr/{name()}" for _ in range(900)] + [f"http://q.org/{name()}" for _ in range(60)]
    urls += [urls[-1], urls[0], None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    text = lambda u: "    " + (u or "").removeprefix("http://") + " "
    back = spark.createDataFrame([(i, text(u)) for i, u in enumerate(urls)], "i long, t string").where("pmod(xxhash64(t), 5) = 0")
    kept_back = {r.i for r in back.collect()}
    train = [(text(u), ".com/" in u) for i, u in enumerate(urls) if u and "q.org" not in u and i not in kept_back]
    got = {r.page_id: r.score for r in url_verdicts(pages).collect()}
    assert len(got) == len(urls)
    assert np.allclose([got[i] for i in range(len(urls))], _brute_scores(train, [text(u) for u in urls]), rtol=0, atol=1e-9)


def _digest(x):
    return base64.b32encode(hashlib.sha1(x).digest()).decode()


@pytest.mark.parametrize("split", [50, 4096, 1 << 20])
def test_archives_round_trip(spark, split):
    body = "x" * 5000 + "".join(chr(33 + i % 90) for i in range(3000))
    table = [(1, "http://a/\r\nx y", "same"), (2, None, "same"), (5, "u", "same"), (3, "u", None), (4, "u", ""), (6, "u", body),
             (None, "u", "same"), (7, "u", "\x1f\x8b\x08 no member é"), (7, "v", "\x1f\x8b\x08 no member é")]
    pages = spark.createDataFrame(table, "page_id long, url string, html string").withColumns({"n": F.lit(1), "sha": F.lit(2), "id": F.lit(3)})
    got = archive_round_trip(pages, split_bytes=split).collect()
    want = []
    for i, _, h in table:
        body_bytes = (h or "").encode()
        known = [j for j, _, g in table if (g or "") == (h or "") and j is not None]
        revisit = i is not None and i < max(known)
        want.append(str((i, len(body_bytes), _digest(body_bytes), "revisit" if revisit else "response", max(known) if revisit else None)))
    assert sorted(str(tuple(g)) for g in got) == sorted(want)
    assert archive_round_trip(pages.limit(0)).count() == 0


def test_payloads_are_read_back_and_damage_is_passed_over(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    manifest = write_warc(pages, str(tmp_path))
    got = {r.record_id: bytes(r.payload).decode() for r in read_warc(manifest, split_bytes=700).collect()}
    assert got == {str(i): f"page {i} " * 50 for i in range(40)}
    whole = b"".join([record_bytes("1", "u", b"one", None), b"\x1f\x8b\x08junk", record_bytes("2", "u", b"two", None)])
    import pyarrow as pa
    assert len(list(members_from(pa.BufferReader(whole), 0, len(whole), len(whole)))) == 2


def test_damaged_archives_are_refused(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(3)], "page_id long, url string, html string").coalesce(1)
    manifest = write_warc(pages, str(tmp_path))
    name, = (r.archive for r in manifest.collect())
    checked(read_warc(manifest), manifest)
    body = bytearray(open(name, "rb").read())
    placed = read_warc(manifest).orderBy("at").collect()
    starts = [r.at for r in placed]
    body[starts[1] + 40] ^= 0xFF
    open(name, "wb").write(body)
    for split in (64, 1 << 20):
        got = read_warc(manifest, split_bytes=split)
        assert sorted(r.record_id for r in got.where("type != 'damaged'").collect()) == sorted([placed[0].record_id, placed[2].record_id])
        with pytest.raises(ValueError, match="2 of 3 records"):
            checked(got, manifest)
    lost, = read_warc(manifest).where("type = 'damaged'").collect()
    assert (lost.at, lost.payload_bytes) == (starts[1], starts[2] - starts[1])


def _leaks(text, items, window=10):
    find = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    w, hit, names = find(text), set(), set()
    for name, item in items:
        x = find(item)
        k = min(window, len(x))
        if name is None or not x:
            continue
        wanted = {tuple(x[i:i + k]) for i in range(len(x) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i:i + k]) in wanted:
                hit |= set(range(i, i + k))
                names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


@pytest.mark.parametrize("options", [{}, {"block_bytes": 100, "shard_words": 50}])
def test_leaks_of_messy_rows(spark, options):
    long = rows()[14][1].split(" ")
    items = [(1, " ".join(long[500:530])), (2, "One, TWO three!"), (3, None), (None, "one two three"), (4, ""), (5, "no such words at all here"),
             (10, "Straße ñandú"), (6, " ".join(long[520:532])), (6, "far id"), (7, "w")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit("x"))
    got = leak_report(messy(spark), benchmark, **options).collect()
    want = sorted(str((r[0], *_leaks(r[1], items))) for r in rows())
    assert sorted(str((g.doc_id, g.n_words, g.n_hit, g.n_items, g.items_sha256)) for g in got) == want
    assert all(g.contaminated == (g.n_hit > 0) for g in got) and any(g.contaminated for g in got)
    clean = drop_leaks(messy(spark), benchmark, **options)
    assert clean.count() == sum(_leaks(r[1], items)[1] == 0 for r in rows()) and clean.columns == messy(spark).columns
    assert leak_report(messy(spark), benchmark.limit(0)).where("contaminated").count() == 0
    assert leak_report(empty(spark), benchmark).count() == 0


def test_index_against_plain_search():
    draw = np.random.default_rng(2)
    for _ in range(60):
        s = draw.integers(1, 4, draw.integers(1, 80))
        assert suffix_array(np.append(s, 0)).tolist() == sorted(range(len(s) + 1), key=lambda i: [*s[i:], 0])
        index, lengths = FMIndex(s, 5, 4), draw.integers(1, 5, 10)
        phrases = np.zeros((10, 4), np.int64)
        for i, n in enumerate(lengths):
            phrases[i, 4 - n:] = draw.integers(1, 5, n)
        low, high = index.search(phrases, lengths)
        for i, n in enumerate(lengths):
            found = index.locate(np.arange(low[i], max(low[i], high[i])))
            assert sorted(found.tolist()) == [j for j in range(len(s) - n + 1) if s[j:j + n].tolist() == phrases[i, 4 - n:].tolist()]
        tree, at = Wavelet(s, 2), draw.integers(0, len(s) + 1, 5)
        assert tree.rank(np.full(5, 2), at).tolist() == [int((s[:p] == 2).sum()) for p in at]
        assert tree.access(np.arange(len(s))).tolist() == s.tolist()
    a, b = merged(np.array([5, 1, 2, 9]), np.array([7, 3, 5, 10]))
    assert a.tolist() == [1, 9] and b.tolist() == [7, 10]
