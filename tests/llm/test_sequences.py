"""Shards, the conversation trie and conversation repair against brute force, and odd input."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from crosspanel.llm import queries, repair, shards, trie

TURNS = "conv_id long, turn long, role string, text string"


# 11. Shards


def shuffled_by_hand(rows, n_shards, seed, bucket_rows):
    """The same order in plain Python: (doc_id, text) to (shard, slot), copies in any order."""
    number = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    seen, keyed = {}, []
    for doc_id, text in rows:
        key = (doc_id, text)
        k = seen[key] = seen.get(key, -1) + 1
        keyed.append((f"{seed}:{'' if doc_id is None else doc_id}:{'' if text is None else hashlib.md5(text.encode()).hexdigest()}:{k}", key))
    buckets = max(-(-len(rows) // bucket_rows), 1)
    bins = {}
    for name, key in keyed:
        bins.setdefault(number(name) % buckets, []).append((hashlib.md5(name.encode()).hexdigest(), key))
    line = []
    for b in sorted(bins, key=lambda b: (b % shards.LANES, b)):
        order = []
        for i, x in enumerate(sorted(bins[b]), 1):
            j = number(f"{seed}:{b}:{i}") % i
            order.append(x)
            order[j], order[-1] = order[-1], order[j]
        line += [key for _, key in order]
    least, larger = divmod(len(rows), n_shards)
    out, at = [], 0
    for s in range(n_shards):
        for slot in range(least + (s < larger)):
            out.append((line[at], s, slot))
            at += 1
    return out


@pytest.mark.parametrize("n, n_shards, bucket_rows", [(100, 7, 16), (5, 24, 2048), (300, 24, 8)])
def test_shuffle_is_fisher_yates_per_bucket(make, n, n_shards, bucket_rows):
    rows = [(i // 2 if i % 5 else None, None if i % 7 == 0 else f"text {i // 3} é") for i in range(n)] + [(1, "same")] * (n // 2)
    got = shards.shuffle_records(make(rows), n_shards, 5, bucket_rows).collect()
    strange = lambda x: (x[1], x[2], str(x[0]))
    assert sorted((((r.doc_id, r.text), r.shard, r.slot) for r in got), key=strange) == sorted(shuffled_by_hand(rows, n_shards, 5, bucket_rows), key=strange)
    for r in got:
        raw = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_shuffle_spreads_copies_and_doesnt_depend_on_partitions(spark, make):
    rows = [(7, "copied text")] * 3000 + [(i, f"t{i}") for i in range(1000)]
    docs = make(rows)
    a = shards.shuffle_records(docs.repartition(7), bucket_rows=64).select("doc_id", "shard", "slot").collect()
    b = shards.shuffle_records(docs.coalesce(1), bucket_rows=64).select("doc_id", "shard", "slot").collect()
    assert sorted(a) == sorted(b)
    share = [sum(r.doc_id == 7 for r in a if r.shard == s) for s in range(24)]
    assert sum(share) == 3001 and min(share) > 90 and max(share) < 160
    sizes = [sum(r.shard == s for r in a) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_odd_rows_and_written_files(spark, odd, make, tmp_path):
    clashing = odd.withColumns({n: F.lit("clash") for n in ("slot", "shard", "record", "bucket", "hash", "copy", "size", "law")})
    out = shards.shuffle_records(clashing, bucket_bytes=1 << 16)
    rows = out.collect()
    assert len(rows) == 9 and out.columns == [*(c for c in clashing.columns if c not in ("slot", "shard", "size", "law")), "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert all(r["size"] == 8 and r.text_crc32 == 0 for r in rows if not r.text) and {r.record for r in rows} == {"clash"}
    assert shards.shuffle_records(make([])).count() == 0
    shards.write_shards(out.drop("grown_shard"), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r.shard, r.slot, r["size"]) for r in back.collect()) == sorted((r.shard, r.slot, r["size"]) for r in rows)


def test_query_moves_whole_records_into_shards(spark, make, tmp_path):
    texts = [None if i % 11 == 0 else "" if i % 13 == 0 else f"text {i // 2} é " * (i % 90) for i in range(5000)]
    rows = [(i // 2 if i % 7 else None, t, "en", f"source {i}", len(t or "")) for i, t in enumerate(texts)] + [(1, "same", "de", f"copy {i}", 4) for i in range(500)]
    make(rows).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op11_two_pass_shuffle(spark, str(tmp_path))
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    folders = {f.rsplit("/", 2)[0] for f in out.inputFiles()}
    assert len(folders) == 1 and all("/shard=" in f for f in out.inputFiles())
    held = spark.read.parquet(folders.pop()).select("doc_id", "text", "lang", "source", "n_chars", "shard", "slot", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).collect()
    assert sorted((tuple(r[:5]) for r in held), key=str) == sorted(rows, key=str)
    want = shuffled_by_hand([r[:2] for r in rows], shards.SHARDS, shards.SEED, shards.BUCKET_ROWS)
    assert sorted((((r.doc_id, r.text), r.shard, r.slot) for r in held), key=str) == sorted(want, key=str)
    for _, run in itertools.groupby(sorted(held, key=lambda r: (r.file, r.at)), key=lambda r: r.shard):
        assert [r.slot for r in run] == list(range(sum(r.shard == _ for r in held)))
    raw = {(r.shard, r.slot): (r.text or "").encode() for r in held}
    got = out.collect()
    assert len(got) == len(raw) == len(rows)
    for r in got:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw[r.shard, r.slot]) + 8, zlib.crc32(raw[r.shard, r.slot]), "rows", None)


def test_query_of_shards_on_empty_table(spark, make, tmp_path):
    make([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op11_two_pass_shuffle(spark, str(tmp_path)).collect() == []


# 12. Trie


def test_two_fattest():
    for low, high in itertools.combinations(range(40), 2):
        power = lambda x: x & -x
        assert trie.two_fattest(low, high) == max(range(low + 1, high + 1), key=power)


def nodes_by_hand(conversations):
    """All columns of the query from the rebuilt sequences {conv_id: [(role, text), ...]}."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, m in members.items():
        under = [q for q in members if q[: len(p)] == p]
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in under), sum(not any(len(r) > len(q) and r[: len(q)] == q for r in under) for q in under),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in under if q), hashlib.sha256(",".join(str(c) for c in sorted(m) if len(conversations[c]) == len(p)).encode()).hexdigest(),
        ))
    return out


def rebuilt_by_hand(rows):
    own = {}
    for c, turn, role, text in rows:
        own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items() if c is not None}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def some_conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.randrange(400)
        if any(r[0] == c for r in rows):
            continue
        for t in range(rng.choice([1, 2, 3, 7, 20])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t % 3 else None, rng.choice([None, "a", "é日", "😀 long text"])))
    return rows


@pytest.mark.parametrize("seed, n, batch", [(1, 60, 10), (2, 150, 10**6), (3, 150, 40)])
def test_trie_equals_brute_force(spark, seed, n, batch):
    rows = some_conversations(seed, n) + [(None, 0, "user", "nobody's")]
    random.Random(seed).shuffle(rows)
    table = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("own", "least", "n", "depth")})
    got = trie.prefix_trie(trie.rebuilt(table), batch).collect()
    assert sorted(map(tuple, got), key=str) == sorted(nodes_by_hand(rebuilt_by_hand(rows)), key=str)


def test_trie_locates_every_path():
    rng = random.Random(4)
    paths = [[bytes([rng.randrange(3)]) for _ in range(rng.randrange(30))] for _ in range(300)]
    paths = [[b"".join(p[:d]).ljust(1) + bytes([d]) for d in range(1, len(p) + 1)] for p in paths]
    z = trie.ZFastTrie(1)
    for k, p in enumerate(paths):
        longest = max((len(list(itertools.takewhile(lambda x: x[0] == x[1], zip(p, q, strict=False)))) for q in paths[:k]), default=0)
        assert z.locate(p)[1] == longest
        z.insert(p, k, [1])
    assert sum(sums[0] for top, _, _, _, sums in z.expanded() if top < 0) == 300


def test_trie_odd_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(trie.rebuilt(empty)).count() == 0
    # Conversation 1 (h = 1) has one turn and no base; 101 copies a long one; nulls and ties in turns.
    long = [(100, t, "user", f"turn {t}") for t in range(3000)]
    rows = [(1, 0, "user", "alone"), (5, None, None, None), (5, None, None, None), (5, 2, "user", ""), (7, 1, "b", "x"), (7, 1, "a", "y"), (7, 1, "b", "x")] + long + [(101, *r[1:]) for r in long]
    got = sorted(map(tuple, trie.prefix_trie(trie.rebuilt(spark.createDataFrame(rows, TURNS))).collect()), key=lambda r: (r[1], r[0]))
    turnless = [r for r in got if r[1] == 0]
    assert len(turnless) == 1 and turnless[0][3] == 5 and max(r[1] for r in got) == 3000
    assert turnless[0][5] == len({tuple(v) for v in rebuilt_by_hand(rows).values() if v})


# 13. Repair


def repairs_by_hand(initials, faults):
    """The least (cost, audit) by dynamic programming over all states, with whole strings."""
    best = {(0, repair.START): (0, "")}
    for i in range(len(initials) + 1):
        for _ in range(3):
            for state in range(4):
                if (i, state) in best:
                    cost, audit = best[i, state]
                    to = (i, repair.NEXT[state])
                    best[to] = min(best.get(to, (10**9, "")), (cost + 3, audit + "I"))
        if i < len(initials):
            for state in range(4):
                if (i, state) in best:
                    cost, audit = best[i, state]
                    for edit, price, used, to in repair.moves(state, initials[i], faults[i]):
                        if used:
                            best[i + 1, to] = min(best.get((i + 1, to), (10**9, "")), (cost + price, audit + edit))
    return min(best[len(initials), s] for s in repair.DONE if (len(initials), s) in best)


def script_cost(initials, faults, audit):
    """Cost of an audit, or None if it doesn't give a legal conversation."""
    at, cost, out = 0, 0, ""
    for edit in audit:
        if edit == "I":
            out += "a" if out[-1:] == "u" else "u"
            cost += 3
            continue
        if at == len(initials):
            return None
        fault = faults[at]
        if edit == "D":
            cost += 4
        elif fault in (repair.BLANK, repair.DUPLICATE):
            return None
        else:
            cost += (3 if edit == "R" else 0) + (3 if fault == repair.TRUNCATED else 0)
            out += initials[at] if edit == "K" else "a" if out[-1:] == "u" else "u"
        at += 1
    rest = out[1:] if out.startswith("s") else out
    legal = at == len(initials) and (not out or rest and rest == "ua" * (len(rest) // 2))
    return cost if legal else None


def test_cheapest_script_against_all_scripts():
    for n in range(4):
        for initials in itertools.product("suax", repeat=n):
            for faults in itertools.product((repair.FINE, repair.BLANK, repair.TRUNCATED), repeat=n):
                found = repair.cheapest(list(initials), list(faults))
                assert found == repairs_by_hand(initials, faults) and script_cost(initials, faults, found[1]) == found[0]
    scripts = ["".join(s) for k in range(7) for s in itertools.product("DIKR", repeat=k)]
    for initials, faults in [("us", (0, 0)), ("au", (0, 3)), ("sx", (3, 0)), ("uu", (0, 2)), ("a", (0,)), ("ss", (0, 0))]:
        every = [(c, s) for s in scripts if (c := script_cost(initials, faults, s)) is not None]
        assert repair.cheapest(list(initials), list(faults)) == min(every)


def test_search_is_right_with_weaker_bounds(monkeypatch):
    """Incumbent and dominance alone prove the optimum when the bounds say nothing."""
    rng = random.Random(5)
    cases = [([rng.choice("suax") for _ in range(n)], [rng.choice((0, 0, 1, 2, 3)) for _ in range(n)]) for n in range(9) for _ in range(25)]
    want = [repairs_by_hand(*c) for c in cases]
    assert [repair.cheapest(*c) for c in cases] == want
    monkeypatch.setattr(repair, "suffix_bounds", lambda initials, faults: [[0] * 4 for _ in range(len(initials) + 1)])
    assert [repair.cheapest(*c) for c in cases] == want


def test_long_conversations_are_repaired():
    rng = random.Random(6)
    initials, faults = [rng.choice("uuuaaas") for _ in range(20_000)], [rng.choice((0, 0, 0, 1, 2, 3)) for _ in range(20_000)]
    cost, audit = repair.cheapest(initials, faults)
    assert script_cost(initials, faults, audit) == cost == repair.suffix_bounds(initials, faults)[0][repair.START]


def test_repair_rows_and_odd_input(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 3, "assistant", "Yes"), (2, None, None, None), (2, None, "bot", "Hello!  "), (3, 5, "", "x."), (None, 0, "user", "x."), (4, 0, "system", "Be.")]
    table = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("cost", "audit", "place", "pass")})
    got = sorted(map(tuple, repair.repair_rows(table).collect()), key=str)
    assert sorted(got, key=str) == sorted([
        (1, 0, "K", "user", "Hi."), (1, None, "D", None, None), (1, 1, "K", "assistant", "Yes"),
        (2, None, "D", None, None), (2, None, "D", None, None), (3, None, "D", None, None), (4, None, "D", None, None),
    ], key=str)
    told = {r.conv_id: r for r in repair.repair_digests(table).collect()}
    assert tuple(told[1])[1:8] == (1, 0, 1, 1, 1, 7, "KDK") and told[1].repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:Yes").hexdigest()
    assert tuple(told[2])[1:8] == (0, 1, 0, 1, 1, 8, "DD")
    assert sorted(told) == [1, 2, 3, 4] and repair.repair_digests(spark.createDataFrame([], TURNS)).count() == 0


def test_damage_kinds(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(12) for t in range(4)] + [(3, None, None, None)]
    key = lambda c, t: zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
    for r in repair.damaged(spark.createDataFrame(rows, TURNS)).collect():
        kind, null = key(r.conv_id, r.turn), r.turn is None
        assert r.gone == (kind == 0) and r.twice == (kind == 3)
        assert r.role == ("user" if kind == 4 else " " if null else "assistant")
        assert r.text == ("" if kind == 1 else (" " if null else "One Two Three") if kind == 2 else " " if null else "One. Two! Three?")
    only = next(c for c in range(10**6) if key(c, 0) == 0)
    gone = repair.repair_digests(repair.damaged(spark.createDataFrame([(only, 0, "user", "x.")], TURNS))).first()
    assert tuple(gone) == (only, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
