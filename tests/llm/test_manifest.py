"""The Merkle manifest against one that is made node by node."""

import hashlib
import zlib

import messy
import pytest

from tagloom.llm.merkle import manifest, tampered_third

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """The last node and, for each leaf, its siblings as (left, right) from the lowest level up."""
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [slice(a, a + fanout) for a in range(0, len(nodes), fanout)]
        for run in runs:
            for j, leaves in enumerate(below[run]):
                for i in leaves:
                    paths[i].append(("".join(nodes[run][:j]), "".join(nodes[run][j + 1:])))
        nodes, below = [sha("".join(nodes[run])) for run in runs], [sum(below[run], []) for run in runs]
    return nodes[0], paths


def by_hand(rows, fanout=8):
    groups = {}
    for row in rows:
        values = dict(zip(FIELDS, row))
        lower = values["text"] and "".join(c.lower() if "A" <= c <= "Z" else c for c in values["text"])
        tampered = values["doc_id"] is not None and zlib.crc32(str(values["doc_id"]).encode()) % 3 == 0
        found = leaf_of((values | {"text": lower}).values()) if tampered else leaf_of(row)
        groups.setdefault(values["lang"], []).append((values["doc_id"], leaf_of(row), found))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [tree([x[1] for x in groups[lang]], fanout) for lang in langs]
    root, tops = tree([t[0] for t in trees], fanout) if trees else (None, [])
    for lang, (subroot, paths), top in zip(langs, trees, tops):
        for (doc, leaf, found), path in zip(groups[lang], paths):
            folded = found
            for left, right in path + top:
                folded = sha(left + folded + right)
            yield doc, leaf, subroot, root, sha("".join(a + b for a, b in path + top)), folded, folded == root


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("fanout", [8, 2])
def test_messy_table(spark, fanout):
    docs = messy.messy(spark)
    got = rows_of(manifest(docs, tampered_third(), fanout=fanout))
    assert got == sorted(by_hand([tuple(r) for r in docs.select(*FIELDS).collect()], fanout), key=repr)
    assert {g[-1] for g in got} == {True, False}


def test_few_rows(spark):
    assert manifest(messy.empty(spark)).count() == 0
    docs = spark.createDataFrame([(7, "s", "en", 1, "A")], "doc_id long, source string, lang string, n_chars long, text string")
    (only,) = manifest(docs).collect()
    assert only.leaf == only.subroot == only.root == only.folded_root == leaf_of((7, "s", "en", 1, "A"))
    assert only.proof_sha256 == sha("") and only.verified


def test_many_groups_and_a_hot_one(spark):
    docs = spark.range(700).selectExpr(
        "id AS doc_id", "'s' AS source", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('l', id % 20) END AS lang",
        "id AS n_chars", "concat('Text ', id) AS text").repartition(7)
    got = rows_of(manifest(docs, tampered_third()))
    assert got == sorted(by_hand([tuple(r) for r in docs.select(*FIELDS).collect()]), key=repr)


def test_fanout_must_be_a_power_of_two(spark):
    with pytest.raises(ValueError):
        manifest(messy.empty(spark), fanout=6)
