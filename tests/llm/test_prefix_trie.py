"""The trie of conversations against dictionaries of prefixes and DuckDB."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from philolog.llm import prefix_trie, registry
from philolog.llm.queries_trie import _OP12

SCHEMA = "conv_id long, turn long, role string, text string, code string, bucket long, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Rebuilt conversations and their prefixes by dictionaries."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, own_members in members.items():
        gain = (len(own_members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += gain
    return {(min(m), len(p)): (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()}


def found(spark, tmp_path, rows, name="a"):
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/{name}/conversations.parquet")
    out = registry.queries()["op12_prefix_trie"](spark, f"{tmp_path}/{name}")
    assert out.columns == COLUMNS
    return out.collect()


def odd_rows():
    draw = random.Random(8)
    texts = ["a b", "a b", "c", "", None, " d  e f ", "é\tg"]
    rows = [(c, t, draw.choice(["u", "a", None]), draw.choice(texts), "x", 1, None) for c in range(0, 260) for t in range(draw.choice([0, 1, 2, 3, 5]))]
    rows += [(c, t, "u", f"same {t}", None, None, None) for c in range(300, 420) for t in range(6)]
    rows += [(500, t, "u", f"long {t}", None, None, None) for t in range(700)] + [(501, t, "u", f"long {t}", None, None, None) for t in range(690)]
    rows += [(None, 1, "u", "lost", None, None, None), (7, None, "s", "first", None, None, None), (7, 1, "u", "twice", None, None, None), (7, 1, "u", "twice", None, None, None), (-3, 1, "u", "a b", None, None, None), (-20, 0, "u", "c", None, None, None), (600, 1, "u", "w " * 200_000, None, None, None)]
    return rows


@pytest.mark.parametrize("turns", [20, 1 << 15])
def test_equals_dictionaries(spark, tmp_path, turns, monkeypatch):
    """Buckets of at most 20 turns take many rounds; large ones none. A chain of 700 turns is skipped in one."""
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    monkeypatch.setattr(prefix_trie.prefix_trie, "__kwdefaults__", {"local_turns": turns})
    rows = odd_rows()
    got = found(spark, tmp_path, rows)
    want = plain(rows)
    assert len(got) == len(want)
    assert {(r["conv_id"], r["depth"]): tuple(r) for r in got} == want


def test_odd_tables(spark, tmp_path):
    assert found(spark, tmp_path, [], "e") == []
    assert found(spark, tmp_path, [(None, 1, "u", "x", None, None, None)], "n") == []
    (root,) = found(spark, tmp_path, [(7, 1, "u", "x", None, None, None)], "one") if zlib.crc32(b"7") % 4 else [None]
    assert root is None or (root["conv_id"], root["depth"], root["n_convs"], root["n_leaves"]) == (7, 0, 1, 1)


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    want = con.execute(_OP12).fetchall()
    got = [tuple(r) for r in registry.queries()["op12_prefix_trie"](spark, folder).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
