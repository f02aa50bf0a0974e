import random

from . import cases


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def allowed(size):
    return 2 if size >= 24 else 1 if size >= 12 else 0


def slow(data):
    lines = sorted({(d is None, d or 0, p, line) for d, text, *_ in data if text for p, line in enumerate(text.split("\n")) if line.strip(" \t\n\x0b\x0c\r")})
    gone = {}
    for k, (u, d, p, line) in enumerate(lines):
        own = line.encode()
        for earlier in lines[:k]:
            if earlier[:3] == (u, d, p):
                continue
            other = earlier[3].encode()
            if own == other:
                gone[u, d, p, line] = "equal"
                break
            edits = allowed(min(len(own), len(other)))
            if edits and abs(len(own) - len(other)) <= edits and distance(own, other) <= edits:
                gone[u, d, p, line] = "near"
    out = []
    for d, text, *_ in data:
        lines = text.split("\n") if text is not None else []
        fate = [gone.get((d is None, d or 0, p, x)) for p, x in enumerate(lines)]
        kept = "\n".join(x for x, f in zip(lines, fate) if not f) if text is not None else None
        out.append((str(d), kept, len(lines), fate.count("equal"), fate.count("near")))
    return sorted(out, key=str)


def edited(rng, line, n):
    for _ in range(n):
        p = rng.randrange(len(line))
        line = rng.choice((line[:p] + line[p + 1 :], line[:p] + "é" * (n > 1) + "q" + line[p:], line[:p] + "z" + line[p + 1 :]))
    return line


def test_edit_distance(spark):
    from pyspark.sql import functions as F
    from verdigris.llm.linededup import edit_distance

    rng, data = random.Random(3), []
    for i in range(200):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(6, 30)))
        b = edited(rng, a, rng.randint(0, 3)) if i % 2 else "".join(rng.choice("ab") for _ in range(len(a) + rng.randint(-2, 2)))
        b = b.replace("é", "")
        if len(b) > 3 and abs(len(a) - len(b)) <= 2:
            data.append((a, b))
    for edits in (1, 2):
        rows = [(a, b) for a, b in data if abs(len(a) - len(b)) <= edits]
        got = spark.createDataFrame(rows, "a string, b string").select("a", "b", edit_distance(F.split("a", ""), F.split("b", ""), edits).alias("d")).collect()
        for r in got:
            want = distance(r.a.encode(), r.b.encode())
            assert (r.d == want) if want <= edits else r.d > edits, (r, want)


def test_near_lines_match_brute_force(spark):
    from pyspark.sql import functions as F
    from verdigris.llm.linededup import dedup_lines

    rng, data = random.Random(5), cases.rows(20)
    base = [cases.prose(i, 14).replace("\n", " ") for i in range(12)]
    for i in range(60):
        data.append((100 + i, "\n".join(edited(rng, rng.choice(base), rng.randint(0, 4)) for _ in range(3)), "en", "s", 1))
    short = [cases.prose(i, 3).replace("\n", " ")[:n] for i in range(6) for n in (10, 12, 17, 23, 24, 25)]
    for i in range(60):
        data.append((200 + i, "\n".join(edited(rng, rng.choice(short), rng.randint(0, 3)).replace("é", "") for _ in range(3)), "en", "s", 1))
    data += [(300, "short\nline\n\nshort", "en", "s", 1), (301, "", "en", "s", 1), data[30], (None, base[0], None, None, None)]
    docs = cases.clashing(cases.table(spark, data)).withColumnRenamed("copies", "t").withColumn("_of", F.lit(1)).withColumn("_text", F.lit(2))
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_equal", "n_near"]
    assert sorted(((str(r.doc_id), r.text, r.n_lines, r.n_equal, r.n_near) for r in got.collect()), key=str) == slow(data)
    assert dedup_lines(cases.table(spark, [])).collect() == []


def test_large_groups(spark, monkeypatch):
    """Many lines with a common segment, near and not, over several blocks."""
    from verdigris.llm import linededup

    monkeypatch.setattr(linededup.near_later, "__defaults__", (linededup.EDITS, 16))
    rng = random.Random(8)
    head = cases.prose(1, 8).replace("\n", " ")
    data = [(i, head + " " + "".join(rng.choice("abcdefgh") for _ in range(12)), "en", "s", 1) for i in range(60)]
    data += [(500 + i, edited(rng, data[rng.randrange(60)][1], 2), "en", "s", 1) for i in range(20)]
    data += [(900 + i, f"{head} number {i:04d}", "en", "s", 1) for i in range(50)]
    got = linededup.dedup_lines(cases.table(spark, data)).collect()
    assert sorted(((str(r.doc_id), r.text, r.n_lines, r.n_equal, r.n_near) for r in got), key=str) == slow(data)


def test_trimmed_distance(spark):
    from pyspark.sql import functions as F
    from verdigris.llm.linededup import within

    rng, data = random.Random(9), []
    for i in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(3, 40)))
        data.append((a.encode(), edited(rng, a, rng.randint(0, 4)).replace("é", "").encode()))
    rows = spark.createDataFrame(data, "a binary, b binary").select("a", "b", *[within(F.col("a"), F.col("b"), k).alias(f"w{k}") for k in (1, 2)])
    for r in rows.collect():
        assert (r.w1, r.w2) == tuple(distance(bytes(r.a), bytes(r.b)) <= k for k in (1, 2)), r


def test_one_row_a_line_however_many_are_near(spark):
    from pyspark.sql import functions as F
    from verdigris.llm import linededup

    head = cases.prose(1, 30).replace("\n", " ")
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(head), F.lpad((F.col("id") % 100).cast("string"), 2, "0"), F.lit(head)).alias("text"))
    rows = linededup.line_rows(docs)
    classes = rows.groupBy("h", "g").agg(F.min("place").alias("first"))
    assert linededup.near_later(classes, rows.select("h", "g", "bytes")).count() == 99


def test_near_lines_share_a_compiled_key(spark):
    import random

    from verdigris.llm import linededup

    rng, data = random.Random(4), []
    for i in range(300):
        line = "".join(rng.choice("abcdef") for _ in range(rng.randint(12, 60)))
        other = list(line)
        for _ in range(2 if len(line) >= 26 else 1):
            at = rng.randrange(len(other))
            other[at : at + rng.randint(0, 1)] = rng.choice(["", "x"])
        other = "".join(other)
        if min(len(line), len(other)) >= (24 if len(line) >= 26 else 12):
            data += [(i, 0, line.encode()), (i, 1, other.encode())]
    got = linededup.keyed(spark.createDataFrame(data, "i int, side int, bytes binary"), ["i", "side"])
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
    seen = {}
    for r in got.collect():
        seen.setdefault((r.i, r.side), set()).add(r.key)
    assert len(data) > 500 and all(seen[i, 0] & seen[i, 1] for i, side, _ in data if not side)
