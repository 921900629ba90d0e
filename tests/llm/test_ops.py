"""The training-data operators against brute force, round trips, SQL and held-out accuracy, with the odd cases each
must take: nulls, empty and long texts, ties, repeated rows, empty tables, further columns with clashing names."""

import base64
import hashlib
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quartzite.llm import common, compression, decontaminate, extract, licences, linededup, pieces, rules, simhash, substrings, warc

TABLES = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, pays string, k long, bucket string"
random.seed(7)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(random.randint(1, 7))) for _ in range(300)]


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ".\n", ","]) for _ in range(n))


def odd_texts() -> list[str | None]:
    base = prose(120, 1)
    return [base, None, "", " \n\t ", base, base + " tail", "x" * 5000, prose(3000, 2), "one", base.replace("a", "b", 1), "é ü ß ﬁ 你好 𝕏 " + prose(30, 3), prose(40, 4) + "\n" + base, "\n".join(["same line here"] * 9), "ab " * 200]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k * 3, t, "clash", 1, "x") for k, t in enumerate(odd_texts())]
    rows += [rows[0], (None, prose(60, 9), None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS), [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def order(rows):
    """Documents as (id or the smallest, text hash) in the operators' order, null ids first."""
    return sorted(rows, key=lambda r: common.NULL_ID if r[0] is None else r[0])


# 1: line dedup


def lines_by_force(rows, w):
    seen, out = {}, {}
    own = [((common.NULL_ID if k is None else k, t or ""), linededup.line_hashes(t)[0]) for k, t in rows]
    for key, h in own:
        for s in range(len(h) - w + 1):
            seen.setdefault(tuple(h[s : s + w]), set()).add((key[0], s, key[1]))
    for key, h in own:
        starts = []
        for s in range(len(h) - w + 1):
            mine = (key[0], s, key[1])
            if any((o[0], o[1]) < (mine[0], mine[1]) or (o[0] < mine[0]) for o in seen[tuple(h[s : s + w])] if o != mine and not (o[0] == mine[0] and o[2] != mine[2])):
                starts.append(s)
        out[key] = linededup.strip(key[1] or None, starts, w)
    return out


def test_line_dedup(odd, none):
    df, rows = odd
    want = lines_by_force(rows, 3)
    got = linededup.remove_runs(df).collect()
    assert len(got) == len(rows)
    for r in got:
        kept, n, gone, runs = want[(common.NULL_ID if r["doc_id"] is None else r["doc_id"], r["text"] or "")]
        assert (r["_kept"], r["_lines"], r["_removed"], r["_runs"]) == (kept, n, gone, runs)
    assert any(r["_removed"] for r in got) and linededup.remove_runs(none).count() == 0


def test_line_dedup_finds_what_the_earliest_place_misses(spark):
    body = ["a", "b", "c", "d"]
    texts = ["\n".join(["x", "a", "y"]), "\n".join(body), "\n".join(["q", *body]), "\n".join(body[1:])]
    got = {r["doc_id"]: r["_kept"] for r in linededup.remove_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "x\na\ny", 1: "a\nb\nc\nd", 2: "q", 3: ""}


def test_line_dedup_finds_long_runs_of_few_lines(spark):
    flat = lambda n, seed: " ".join(prose(n, seed).split())
    one, a, b, c, few = flat(50, 31), flat(30, 32), flat(25, 33), flat(49, 34), flat(20, 35)
    texts = [one, f"x\n{a}\n\n{b}\ny", one, f"{few}\n  {one} \nz", f"{a}\n{b}", f"{b}\n{a}", c, c, f"q\n{one}\n{one}", None, ""]
    want = {0: one, 1: texts[1], 2: "", 3: f"{few}\nz", 4: "", 5: texts[5], 6: c, 7: c, 8: "q", 9: "", 10: ""}
    got = linededup.remove_runs(spark.createDataFrame([*enumerate(texts), (0, one)], "doc_id long, text string")).collect()
    assert len(got) == 12 and {r["doc_id"]: r["_kept"] for r in got} == want and [r["_removed"] for r in got if r["doc_id"] == 0] == [0, 0]


CLASH = ["_key", "_k", "_th", "_hash", "_kept", "_lines", "_removed", "_runs", "_starts", "_score", "_turn", "_keep", "_none", "_n", "_t", "_K"]


def clashing(spark, rows):
    """Rows of id and text with columns named as the operators name their own."""
    names = [c for c in CLASH if c != "_K"]
    return spark.createDataFrame([(k, t, *(f"{c}{k}" for c in names)) for k, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))


def test_line_dedup_keeps_columns_of_any_name(spark):
    df = clashing(spark, [(1, "a\nb\nc"), (2, "x\na\nb\nc"), (2, "other"), (None, None)])
    got = linededup.remove_runs(df)
    kept, lines, removed, runs = linededup.names(df.columns)
    assert got.columns == [*df.columns, kept, lines, removed, runs] and len(set(got.columns)) == len(got.columns)
    out = sorted(((r["doc_id"] or 0, r[kept], r["_kept"], r["_key"]) for r in got.collect()), key=str)
    assert out == [(0, "", "_keptNone", "_keyNone"), (1, "a\nb\nc", "_kept1", "_key1"), (2, "other", "_kept2", "_key2"), (2, "x", "_kept2", "_key2")]


# 2: WARC


def test_warc_round_trip(spark, tmp_path):
    bodies = ["<p>\r\n\r\nWARC/1.1\r\n</p>", "", None, "é" * 70000, "same", "same", "same"]
    rows = [(k, f"http://Www.Example.org:80/{k % 3}?a b\n#f", b, "x") for k, b in enumerate(bodies)] + [(6, None, "same", "x"), (None, "u", "alone", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    path = str(tmp_path / "w")
    warc.write(df, path, records_per_file=3)
    got = warc.index(spark, path).collect()
    assert len(got) == len(rows)
    best = {}
    for k, _, b, _ in rows:
        best[b or ""] = max(best.get(b or "", common.NULL_ID), common.NULL_ID if k is None else k)
    want = Counter()
    for k, _, b, _ in rows:
        raw, top = (b or "").encode(), best[b or ""]
        other = top != common.NULL_ID and k != top
        want[(k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if other else "response", top if other else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    empty = str(tmp_path / "none")
    warc.write(df.limit(0), empty)
    assert warc.index(spark, empty).count() == 0
    keys = [(r["url_key"], r["capture_time"], common.NULL_ID if r["page_id"] is None else r["page_id"]) for r in sorted(got, key=lambda r: (r["range_no"], r["range_pos"]))]
    assert keys == sorted(keys)


def test_loser_tree():
    for k in range(6):
        runs = [sorted(random.choices(range(20), k=random.randint(0, 9))) for _ in range(k)]
        assert [x[0] for x in warc.LoserTree([iter([(v,) for v in r]) for r in runs], lambda x: x[0])] == sorted(v for r in runs for v in r)


# 3: rules


def test_measures(odd, none):
    df, rows = odd
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rules.judge(df).collect())
    want = Counter()
    for k, t in rows:
        w = (t or "").encode().split()
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {i + d for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for d in range(3)}
        seen, dup = set(), 0
        for line in (t or "").encode().split(b"\n"):
            if line.split():
                dup += line in seen
                seen.add(line)
        want[(k, len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))] += 1
    assert got == want and rules.judge(none).count() == 0


def test_rules_keep_prose_and_drop_junk(spark):
    junk = [" ".join(w + "***" for w in prose(150, s).split()) for s in range(40)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([prose(150, 100 + s) for s in range(200)] + junk)], "doc_id long, text string")
    got = {r["doc_id"]: r["kept"] for r in rules.judge(df).collect()}
    assert all(got[k] for k in range(200)) and not any(got[k] for k in range(200, 240))


# 4: decontamination


def contaminated_by_force(rows, items):
    shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    out = set()
    for k, t in rows:
        w = decontaminate.words(t)
        for item, text in items:
            iw = decontaminate.words(text)
            if w and iw:
                a, n = shingles(iw), min(len(iw), len(w))
                for s in range(len(w) - n + 1):
                    b = shingles(w[s : s + n])
                    both = sum((a & b).values())
                    if both / (sum(a.values()) + sum(b.values()) - both) >= 0.8:
                        out.add((k, item))
                        break
    return out


def test_decontamination(spark, none):
    items = [(i, prose(random.Random(i).randint(15, 60), 1000 + i)) for i in range(12)] + [(50, "tiny item"), (51, None), (52, ""), (53, prose(20, 1003)), (0, prose(random.Random(0).randint(15, 60), 1000))]
    rows = [(k, prose(40, 2000 + k) + " " + items[k % 12][1].upper() + " " + prose(30, 3000 + k)) for k in range(24)]
    for k in range(24, 48):  # a word changed somewhere
        w = items[k % 12][1].split()
        w[random.Random(k).randrange(len(w))] = "changed"
        rows.append((k, prose(20, 4000 + k) + " " + " ".join(w)))
    rows += [(90, None), (91, ""), (92, "a tiny item here"), (93, "tiny"), (None, items[3][1]), (0, rows[0][1])]
    got = decontaminate.contamination(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == contaminated_by_force(rows, items)
    assert decontaminate.contamination(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_reads_plain_words_by_the_column(monkeypatch):
    """No call for each word that is letters and digits only, and the same rows however the texts are cut."""
    items = [(i, prose(30, 1000 + i)) for i in range(6)] + [(9, "three short words")]
    texts = [" ".join(f"w{k}x{i}" for i in range(500)) for k in range(10)] + [f" \n{prose(9, 77)} - {t.title()}." for _, t in items] + [None, "", "--", "Three; short\x0bwords"]
    index, calls = decontaminate.Index(items), []
    monkeypatch.setattr(decontaminate, "word", lambda t, own=decontaminate.word: calls.append(t) or own(t))
    found = []
    for run in (1, 1000, 4 << 20):
        monkeypatch.setattr(decontaminate, "RUN", run)
        found.append(list(decontaminate.matches(index, pa.array(texts), {})))
        assert len(calls) < 1000  # 5,000 words are in no item
        calls.clear()
    first = len(decontaminate.words(prose(9, 77)))
    assert found[0] == found[1] == found[2]
    assert found[0] == [(10 + k, [(k, 1.0, first + 1)]) for k in range(7)] + [(20, [(6, 1.0, 0)])]


# 5: licences


def test_licences(odd, none, spark):
    mit = licences.TEMPLATES["MIT"][1]
    got = {(r["doc_id"], r["licence"]) for r in licences.scan(spark.createDataFrame([(1, "intro\nLicensed under  the apache LICENSE, version 2.0!\nrest"), (2, mit.replace("THE SOFTWARE IS", "This software is")), (3, "plain"), (None, "Released under the MIT License."), (4, prose(50, 1) + "\n\n" + mit)], "doc_id long, text string")).collect()}
    assert got == {(1, "Apache-2.0"), (2, "MIT"), (None, "MIT"), (4, "MIT")}
    assert licences.scan(odd[0]).count() == 0 and licences.scan(none).count() == 0


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_licences_against_sql(spark):
    import duckdb

    duckdb.sql(f"create or replace view documents as select * from '{TABLES}/documents.parquet'")
    assert sorted(map(tuple, licences.op5_license_scan(spark, TABLES).collect()), key=str) == sorted(((a, b, c, d) for a, b, c, d in duckdb.sql(licences.oracle()).fetchall()), key=str)


def test_licences_finds_customary_notices(spark):
    notices = [
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("All rights reserved.", "Proprietary"), ("Licensed under the MIT License.", "MIT"), ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        ("// SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL"), ("# Licensed under the BSD 3-Clause License", "BSD-3-Clause"),
        ("Licensed under the Apache License 2.0", "Apache-2.0"), ("Released under the Mozilla Public License 2.0.", "MPL-2.0"), ("Licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"), ("Licensed under the ISC License", "ISC"),
    ]
    best = {}
    for r in licences.scan(spark.createDataFrame([(k, f"{prose(9, k)}\n{t}\n{prose(9, k)}") for k, (t, _) in enumerate(notices)], "doc_id long, text string")).collect():
        best[r["doc_id"]] = max(best.get(r["doc_id"], (0, "")), (r["dice"], r["licence"]))
    assert {k: v[1] for k, v in best.items()} == {k: name for k, (_, name) in enumerate(notices)}


def test_licences_finds_wrapped_and_inner_notices(spark):
    import textwrap

    want = {0: ("MIT", 1), 1: ("GPL-3.0", 0), 2: ("ISC", 0), 3: ("BSD-3-Clause", 0), 4: ("MIT", 1), 5: ("Apache-2.0", 1)}
    code = "".join(f"x{k} = f{k}(y, {k})\n" for k in range(40))
    wrapped = lambda k, lead: code + textwrap.fill(licences.TEMPLATES[want[k][0]][want[k][1]], 76, initial_indent=lead, subsequent_indent=lead) + "\n" + code
    texts = [wrapped(k, "") for k in range(4)] + [wrapped(k, " * ") for k in (4, 5)]
    texts += ["Thanks for reading this page. All rights reserved. Released under the MIT License. See you soon.", f"{prose(40, 3)} this project is licensed under the\nMozilla Public License 2.0 {prose(40, 4)}"]
    texts += ["SPDX-License-Identifier: Zlib", "it is licensed under the terms of the house and released under the sun, with all rights kept", texts[0] + prose(300, 5) + texts[0]]
    found = licences.scan(spark.createDataFrame([*enumerate(texts), (0, texts[0]), (None, texts[2])], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["licence"]) for r in found} == {(k, v[0]) for k, v in want.items()} | {(6, "Proprietary"), (6, "MIT"), (7, "MPL-2.0"), (10, "MIT"), (None, "ISC")}
    assert all(r["n_units"] == 1 and r["dice"] > 0.99 for r in found)


# 6: SimHash


def test_simhash(odd, none):
    df, rows = odd
    got = simhash.near_duplicates(df).collect()
    want = {}
    for k, t in rows:
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        want.setdefault(k, set()).add(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)))
    assert len(got) == len(rows) and all(int(r["fingerprint"], 16) in want[r["doc_id"]] for r in got)
    assert simhash.near_duplicates(none).count() == 0


def test_keep_one_loses_no_text_and_no_column(spark):
    low, high = prose(80, 201), prose(80, 202)
    df = clashing(spark, [(2, low), (5, low), (5, high), (None, prose(70, 203)), (None, prose(70, 204)), (7, None), (9, "")])
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    rows = [(r["doc_id"], r["text"], r["_key"], r["_none"]) for r in got.collect()]
    assert sorted(rows, key=str) == sorted([(2, low, "_key2", "_none2"), (5, high, "_key5", "_none5"), (None, prose(70, 203), "_keyNone", "_noneNone"), (None, prose(70, 204), "_keyNone", "_noneNone"), (7, None, "_key7", "_none7")], key=str)


@pytest.mark.parametrize("most", [simhash.HEAVY, 3])
def test_components_by_force(spark, monkeypatch, most):
    """Fingerprints and components through Spark, also with segment values dealt by bands."""
    r, texts = random.Random(77), [prose(60, 300 + s) for s in range(12)]
    for k in range(60):
        words = r.choice(texts[:12]).split()
        words[r.randrange(len(words))] = r.choice(WORDS)
        texts.append(" ".join(words))
    texts += ["", None, texts[3], "one", "two"]
    monkeypatch.setattr(simhash, "HEAVY", most)
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.RADIUS, most))
    fps = [simhash.simhash(t) for t in texts]
    low = list(range(len(texts)))
    for _ in range(len(texts)):
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    low[i] = min(low[i], low[j])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: (f"{fps[k]:016x}", low[k]) for k in range(len(texts))} and len(set(low)) < len(texts) - 5


def test_keep_one_of_each_component(spark):
    a, b, c, d = (prose(80, 60 + k) for k in range(4))
    rows = [(None, a, "x"), (None, b, "x"), (None, b, "x"), (None, None, "x"), (1, c, "x"), (1, d, "x"), (2, d, "x"), (3, c, "x"), (None, c, "x"), (5, a, "x"), (5, a, "x")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _keep string"))
    assert got.columns == ["doc_id", "text", "_keep"]
    assert sorted(((r[0], r[1]) for r in got.collect()), key=str) == sorted([(5, a), (None, b), (None, None), (1, c), (1, d)], key=str)


@pytest.mark.parametrize("dense", [1 << 24, 64])
def test_links_connect_whatever_is_near(spark, monkeypatch, dense):
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(40)]
    for _ in range(400):
        x = r.choice(fps)
        for _ in range(r.randint(1, 5)):
            x ^= 1 << r.randrange(64)
        fps.append(x)
    fps = np.unique(np.array(fps, np.uint64))
    monkeypatch.setattr(simhash, "DENSE", dense)
    key, owner, kind = simhash._probes(fps)
    a, b = simhash._join(key, owner, kind, 4)
    ours = common.local_components(np.searchsorted(fps, a), np.searchsorted(fps, b), len(fps))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= 4)
    assert (ours == common.local_components(i, j, len(fps))).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (-5, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == -5 for i in range(1, 41)) and got[300] == 100


# 7: substrings


def removed_by_force(rows):
    seen, out = {}, []
    for k, t in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - 99):
            key = raw[s : s + 100]
            seen[key] = min(seen.get(key, (2**62, 0)), (common.NULL_ID if k is None else k, s))
    for k, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - 99):
            if seen[raw[s : s + 100]] < (common.NULL_ID if k is None else k, s):
                gone[s : s + 100] = True
        left = bytes(x for x, g in zip(raw, gone, strict=False) if not g)
        out.append((k, len(raw), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), left))
    return Counter(out)


@pytest.mark.parametrize("hot", [256, 1])
def test_substrings(odd, none, monkeypatch, hot):
    df, rows = odd
    r = random.Random(3)
    n, parts = 2, [prose(60, 50 + s) for s in range(8)]
    more = [(100 + k, " ".join(r.choice(parts)[r.randrange(90) :] for _ in range(3))) for k in range(30)]
    spark = df.sparkSession
    own = df.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    if hot == 1:  # the pieces of the work in this process, with every trigger dealt by phrase
        monkeypatch.setattr(substrings, "HOT", 1)
        import pyarrow as pa

        docs = {}
        table = [(common.NULL_ID if k is None else k, xxhash.xxh64_intdigest((t or "").encode()) >> 1, (t or "").encode()) for k, t in rows + more]
        batch = lambda part: pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.binary())], names=["k", "th", "text"])
        first = [pa.Table.from_batches(list(substrings._find_triggers(n)(iter([batch(part)])))) for part in (table[:20], table[20:])]
        first = pa.concat_tables(first)
        settled = [substrings._settle_triggers(first.filter(pa.array(first.column("bucket").to_numpy() == b))) for b in range(n)]
        asked = {}
        for t in settled:
            for kind, k, th, pay in zip(*(t.column(c).to_pylist() for c in ("kind", "k", "th", "pay")), strict=True):
                (docs if kind == 1 else asked).setdefault((k, th), []).append(pay)
        import zstandard

        held = [(k, th, zstandard.compress(raw), asked[k, th]) for k, th, raw in {(k, th): (k, th, raw) for k, th, raw in table}.values() if (k, th) in asked]
        batch2 = pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.array([x[2] for x in held], pa.binary()), pa.array([x[3] for x in held], pa.list_(pa.binary()))], names=["k", "th", "text", "pays"])
        second = pa.Table.from_batches(list(substrings._find_phrases(n)(iter([batch2]))))
        for b in range(n):
            t = substrings._settle_phrases(second.filter(pa.array(second.column("bucket").to_numpy() == b)))
            for k, th, pay in zip(*(t.column(c).to_pylist() for c in ("k", "th", "pay")), strict=True):
                docs.setdefault((k, th), []).append(pay)
        got = Counter((None if k == common.NULL_ID else k, len(raw), *(x := substrings.keep(raw, docs.get((k, th))))[1:], x[0]) for k, th, raw in table)
    else:
        got = Counter((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in substrings.remove(own).collect())
        assert substrings.remove(none).count() == 0
    assert got == removed_by_force(rows + more)


def test_suffix_ranks():
    r = np.random.default_rng(5)
    raw = np.concatenate([r.integers(97, 99, 400), np.tile(r.integers(97, 100, 150), 3)]).astype(np.uint8)
    at = np.arange(len(raw) - 99)
    text = raw.tobytes()
    want = {x: k for k, x in enumerate(sorted({text[p : p + 100] for p in at.tolist()}))}
    assert substrings.suffix_ranks(raw, at).tolist() == [want[text[p : p + 100]] for p in at.tolist()] and len(want) < len(at)


@pytest.mark.parametrize("many, ordered", [(1024, 1 << 20), (2, 1 << 20), (1024, 300)])
def test_strings_of_many_phrases(spark, monkeypatch, many, ordered):
    """One passage in ever different surroundings, by suffix arrays, by fingerprints, and in small chunks."""
    settle = substrings._settle_triggers
    monkeypatch.setattr(substrings, "MANY", many)
    monkeypatch.setattr(substrings, "ORDERED", ordered)
    passage = prose(60, 400)
    rows = [(k, f"{prose(20, 500 + k)} {passage[: 150 + 7 * k]} {prose(20, 600 + k)} {passage[90:]}") for k in range(12)]
    import pyarrow as pa

    raws = [(k, k, t.encode()) for k, t in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in raws]), pa.array([x[1] for x in raws]), pa.array([x[2] for x in raws], pa.binary())], names=["k", "th", "text"])
    first = pa.Table.from_batches(list(substrings._find_triggers(1)(iter([batch]))))
    spans, asked = {}, {}
    for kind, k, pay in zip(*(settle(first).column(c).to_pylist() for c in ("kind", "k", "pay")), strict=True):
        (spans if kind == 1 else asked).setdefault(k, []).append(pay)
    import zstandard

    batch = pa.RecordBatch.from_arrays([pa.array(list(asked)), pa.array(list(asked)), pa.array([zstandard.compress(raws[k][2]) for k in asked], pa.binary()), pa.array(list(asked.values()), pa.list_(pa.binary()))], names=["k", "th", "text", "pays"])
    second = pa.Table.from_batches(list(substrings._find_phrases(1)(iter([batch]))))
    assert (0 in second.column("kind").to_pylist()) == (many == 2)
    for k, pay in zip(*(substrings._settle_phrases(second).column(c).to_pylist() for c in ("k", "pay")), strict=True):
        spans.setdefault(k, []).append(pay)
    got = Counter((k, len(raw), *(x := substrings.keep(raw, spans.get(k)))[1:], x[0]) for k, _, raw in raws)
    assert got == removed_by_force(rows)


# 8: classifier


def test_classifier(spark, odd, none):
    rows = [(k, (prose(80, k) if k % 3 else " ".join(w + "&&&" for w in prose(80, k).split()))) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(600)] + [(None, 1), (5, None)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = compression.fit(docs, labels)
    got = {r["doc_id"]: r["_score"] for r in compression.score(docs, model).collect()}
    assert np.mean([(got[k] >= 0.5) == (k % 3 > 0) for k in range(600)]) > 0.97
    assert all(0 <= r["_score"] <= 1 for r in compression.score(odd[0], model).collect())
    flat = compression.fit(none, labels)
    assert {r["_score"] for r in compression.score(odd[0], flat).collect()} == {0.5}


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_classifier_held_out(spark):
    import pandas as pd

    got = compression.op8_quality_classifier(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.85


def test_classifier_keeps_columns_of_any_name(spark):
    df = clashing(spark, [(k, prose(40, k)) for k in range(5)])
    got = compression.score(df, compression.Model(b"", b"", 0.0, 0.0))
    assert got.columns == [*df.columns, "__score"] and {r["__score"] for r in got.collect()} == {0.5} and {r["_score"] for r in got.collect()} == {f"_score{k}" for k in range(5)}


# 9: HTML


def test_html():
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><p>menu</p></nav><div class="ad">buy</div><article><h1>A &amp; B</h1>
    <p>one  two&nbsp;three<br>four<p>five<!-- no --><script>var x="</p>";</script> six</p><aside>side</aside><div class="comments"><div>c</div>c</div><form>f</form><p>caf&eacute; &lt;x&gt;</p></article><footer>&copy;</footer></body>"""
    assert extract.blocks(page) == [(t, extract.GUARDED) for t in ("A & B", "one two three four", "five six", "café <x>")]
    assert extract.blocks(None) == [] and extract.blocks("<p>cut off <b") == [("cut off", extract.OPEN)]


def test_html_comments_go_and_sections_stay():
    page = """<main><header><h1>Title</h1></header><article><p>one</p><section class="social-history"><p>two</p></section><div class="related-work"><p>three</p></div>
    <div id="notice">four</div><ul class="menu-items"><li>five</li></ul><div class="comment-list"><p>six</p></div><div class="ad-slot-3">seven</div><p>eight</p></article>
    <article class="comment"><p>nine</p><article class="reader-comment">ten</article>eleven</article><section id="comments"><article><p>twelve</p></article></section></main><header>thirteen</header>"""
    got = extract.blocks(page)
    assert [t for t, _ in got] == ["Title", "one", "two", "three", "four", "five", "eight"] and [x for _, x in got] == [0, 0, 1, 1, 1, 1, 0]
    assert extract.blocks("<article class='comment'><p>a</p></article><div class='text'>b</div>") == [("b", extract.OPEN)]


def test_html_hinted_parts_go_by_the_host(spark):
    """Parts of an article whose names hint go where other pages of the host have them, and stay where they do not."""
    links = "read these other stories that our editors chose for you this week"
    rows = [(k, f"http://h.org/{k}", f"<nav>{prose(9, k)}</nav><article><p>{prose(60, 700 + k)}</p><div class='related-box'>{links if k < 4 else prose(12, 800 + k)}</div><p>{links}</p></article>") for k in range(6)]
    got = {r["page_id"]: r["text"].split("\n") for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    flat = lambda n, seed: " ".join(prose(n, seed).split())
    assert got == {k: [flat(60, 700 + k), links] if k < 4 else [flat(60, 700 + k), flat(12, 800 + k), links] for k in range(6)}


def test_html_strings_of_blocks_are_found_wherever_they_stand():
    """Sampled strings: the same block, of any size, in other surroundings gives the same ones, and they cover it."""
    r = random.Random(6)
    for size in (8, 9, 15, 31, 32, 33, 90, 400):
        block = " ".join(r.choice(WORDS) + str(r.randrange(9)) for _ in range(size))
        seen = []
        for k in range(3):
            parts = [prose(20, 900 + k).replace("\n", " ").replace("  ", " ").strip(), block, prose(30, 950 + k).replace("\n", " ").replace("  ", " ").strip()]
            counts = np.array([len(p.split(" ")) for p in parts])
            h, begins = extract.token_hashes(parts), np.cumsum(counts) - counts
            a, b, _ = extract.stretches(h, begins)
            own = (a >= begins[1]) & (b <= begins[2])
            seen.append({(int(x - begins[1]), tuple(h[x:y].tolist())) for x, y in zip(a[own], b[own], strict=True)})
        common_ = seen[0] & seen[1] & seen[2]
        covered = {x + d for x, t in common_ for d in range(len(t))}
        assert covered >= set(range(size)), size


def test_html_repeats_of_a_host(spark, none):
    shared = "this notice is on every page of the host and says nothing new at all"
    rows = [(k, f"http://h.org/{k}", f"<div>{shared}</div><div>{prose(30, 70 + k)}</div>") for k in range(4)] + [(9, "http://other.org/", f"<div>{shared}</div>"), (10, None, None), (None, "http://h.org/x", "")]
    got = {r["page_id"]: r["text"] for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == " ".join(prose(30, 70 + k).split()) for k in range(4)) and got[9] == shared and got[10] == got[None] == ""
    assert extract.main_text(none.selectExpr("doc_id as page_id", "text as html", "pays as url")).count() == 0


def test_html_repeated_articles_stay(spark):
    flat = lambda n, seed: " ".join(prose(n, seed).split())
    menu, quote, article = flat(12, 40), flat(60, 41), [flat(30, 42 + k) for k in range(6)]
    page = lambda *parts: "".join(f"<div>{p}</div>" for p in parts)
    texts = {1: article, 2: article, 3: [*article[:4], "edited", *article[4:]], 4: [flat(90, 50), quote, flat(90, 51)], 5: [flat(90, 52), quote, flat(90, 53)]}
    rows = [(k, f"http://h.org/{k}", page(menu, *parts)) for k, parts in texts.items()] + [(k, f"http://m.org/{k}", page(*article)) for k in (6, 7)]
    got = {r["page_id"]: r["text"] for r in extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "\n".join(parts) for k, parts in texts.items()} | {k: "\n".join(article) for k in (6, 7)}


# 10: pieces


@pytest.mark.skipif(not os.path.exists(common.default_tokenizer(pieces.MODEL)), reason="no vocabulary")
@pytest.mark.parametrize("hot", [0, 50])
def test_pieces_equal_the_library(odd, none, hot):
    import sentencepiece

    df, rows = odd
    sp = sentencepiece.SentencePieceProcessor(model_file=common.default_tokenizer(pieces.MODEL))
    got = pieces.encoded(df, pieces.load(), with_ids=True, hot_words=hot).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((k, tuple(sp.encode(t or ""))) for k, t in rows)
    assert all(r["round_trip"] for r in got) and pieces.encoded(none, pieces.load()).count() == 0


def test_unigram_is_the_best_path(spark):
    r = random.Random(3)
    ps = list(dict.fromkeys([" ", "a", "b", "c", " a", " ab", " cab", *("".join(r.choice("abc") for _ in range(r.randint(2, 5))) for _ in range(30))]))
    v = pieces.Vocabulary(tuple((p, k + 1, -r.randint(1, 40) / 8 - 4 * (len(p) == 1)) for k, p in enumerate(ps)), (), 0, "unigram")
    texts = [" ".join("".join(r.choice("abcx") for _ in range(r.randint(1, 12))) for _ in range(r.randint(0, 5))) for _ in range(60)] + [None, "x" * 70 + "ab" * 40]
    score = {p: s for p, _, s in v.pieces}
    least, name = min(score.values()) - 10, {k: p for p, k, _ in v.pieces}
    for row in pieces.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), v, with_ids=True).collect():
        w = " " + texts[row["doc_id"]] if texts[row["doc_id"]] else ""
        best = [0.0] + [-1e18] * len(w)
        for k in range(1, len(w) + 1):
            for n in range(1, min(k, 6) + 1):
                if (s := score.get(w[k - n : k], least if n == 1 else None)) is not None:
                    best[k] = max(best[k], best[k - n] + s)
        assert sum(score[name[k]] if k in name else least for k in row["ids"]) == pytest.approx(best[-1])


# The pipeline


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = common.read_table(spark, TABLES, "documents")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.cut(stage(spark, docs, TABLES), "stage")
        if k < 4:
            assert out.columns == columns
            assert out.count() <= docs.count() and out.join(docs, "doc_id", "left_anti").count() == 0
            docs = out
    assert out.count() == docs.count() and out.where("not round_trip").count() == 0
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert not contaminated_by_force(left, [(r["item_id"], r["text"]) for r in common.read_table(spark, TABLES, "benchmark").collect()])


def _message(*fields):
    """A protocol-buffer message of (number, value) fields; floats are 32 bits."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, bytes):
            out += varint(number << 3 | 2) + varint(len(value)) + value
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            out += varint(number << 3) + varint(value)
    return out


def test_unigram_model_file_equals_the_library(spark, tmp_path):
    """A unigram model written by hand goes through ``load`` and the Viterbi fold, and its pieces are the library's."""
    import sentencepiece

    r = random.Random(11)
    letters = "abcde"
    ps = sorted({letters[i] for i in range(5)} | {"\u2581"} | {"\u2581" * (r.random() < 0.4) + "".join(r.choice(letters) for _ in range(r.randint(2, 4))) for _ in range(60)})
    rows = [_message((1, b"<unk>"), (2, 0.0), (3, 2)), *(_message((1, p.encode()), (2, -r.randint(1, 4000) / 257), (3, 1)) for p in ps)]
    spec = _message((1, b"identity"), (3, 1), (4, 0), (5, 1))  # a normaliser that adds the dummy space and keeps all others
    raw = _message(*((1, x) for x in rows), (2, _message((3, 1))), (3, spec))
    path = tmp_path / "unigram.model"
    path.write_bytes(raw)
    v = pieces.load(str(path))
    assert v.kind == "unigram" and pieces.model_kind(_message((2, _message((3, 2))))) == "bpe" and pieces.model_kind(b"") == "unigram"
    texts = ["".join(r.choice(letters + "  ") for _ in range(r.randint(1, 40))).strip() or "a" for _ in range(60)]
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    for row in pieces.encoded(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), v, with_ids=True).collect():
        assert row["ids"] == sp.encode(texts[row["doc_id"]]) and row["round_trip"], texts[row["doc_id"]]
    with pytest.raises(ValueError):
        pieces.model_kind(_message((2, _message((3, 3)))))


def test_chosen_numbers_fall_into_their_bucket(spark):
    from itertools import islice

    from pyspark.sql import functions as F

    for n, bucket, first in ((7, 3, 5 << 32), (211, 210, 0), (1, 0, 9)):
        keys = list(islice(common.in_bucket(bucket, n, first), 20))
        got = spark.createDataFrame([(k,) for k in keys], "k long").select(F.expr(f"pmod(hash(k), {n})").alias("b")).distinct().collect()
        assert [r["b"] for r in got] == [bucket] and len(set(keys)) == 20 and min(keys) >= first


def test_bucketed_tables_read_back(spark):
    own = common.cut_buckets(spark.range(50).toDF("k"), "fifty", "k")
    assert sorted(r["k"] for r in own.collect()) == list(range(50))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quartzite_")]
