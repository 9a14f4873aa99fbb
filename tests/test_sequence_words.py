"""Words of instance lines are asked for by block of lines, not by line."""

from recoflow.sources import readers as rd


def _lines(spark, tmp_path):
    rows = [f"1\tu{k % 3}\ti{k % 5}\tc{k % 2}\t{k}\t" + ",".join(f"i{j}" for j in range(k % 4 + 1)) + "\tc0,c9\t1,2" for k in range(40)]
    rows += [rows[7], rows[7], "0\tu1\ti1\tc1\t9", "0\tu9\t\tc1\t9\t\t\t"]  # repeats; a line without histories; empty words
    path = str(tmp_path / "seq")
    spark.createDataFrame([(r,) for r in rows], "value string").repartition(3).write.text(path)
    tables = [spark.createDataFrame(r, "w string, idx long") for r in (
        [("u0", 1), ("u1", 2)], [(f"i{k}", k + 10) for k in range(4)] + [("i2", 5)], [("c0", 1), ("c1", None)])]
    return rows, path, tables


def test_blocks_look_up_as_lines_do(spark, tmp_path, monkeypatch):
    rows, path, tables = _lines(spark, tmp_path)
    users, items, cates = {"u0": [1], "u1": [2]}, {"i0": [10], "i1": [11], "i2": [5, 12], "i3": [13]}, {"c0": [1]}
    want = []
    for r in rows:
        f = r.split("\t")
        if len(f) < 7:
            continue
        every = lambda words, of: [i for w in words.split(",") for i in of.get(w, [0])]
        want.append((f[1], f[4], users.get(f[1], [0])[0], items.get(f[2], [0])[0], cates.get(f[3], [0])[0], every(f[5], items), every(f[6], cates)))
    for size in (1, 4, 4096):
        monkeypatch.setattr(rd, "LINES_A_BLOCK", size)
        got = rd.read_sequences(spark, path, *tables).select(
            "user_id", "ts", "user_idx", "item_idx", "cate_idx", "item_history_idx", "cate_history_idx").collect()
        assert sorted((r[0], str(r[1]), *r[2:]) for r in got) == sorted(want)


def test_no_row_per_place(spark, tmp_path):
    """Only the block's distinct words move; before, each place of a word did, under a hash of its line."""
    _, path, tables = _lines(spark, tmp_path)
    plan = rd.read_sequences(spark, path, *tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5(" not in plan
