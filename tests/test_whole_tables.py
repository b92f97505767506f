"""Queries read every row of their tables: against SQL, or a count, over the whole table."""

import math

import __spark_entry__ as entry
from tests.oracle import SMALL, connect, rows, sql_rows


def test_group_split_conflict_reads_all_documents(spark):
    sql = """
    WITH l AS (SELECT source, CASE WHEN doc_id % 7 = 0 THEN 'test' WHEN doc_id % 7 = 1 THEN 'val' ELSE 'train' END AS split, max(doc_id) AS i FROM documents GROUP BY ALL)
    SELECT 'R3' AS rule, source AS grp, count(*) AS n_splits, min(i) AS record_index, string_agg(split, ',' ORDER BY split) AS splits FROM l GROUP BY source HAVING count(*) > 1
    """
    assert rows(entry.queries()["group_split_conflict"](spark, SMALL)) == sql_rows(connect(), sql)


def boxes(duck, shift):
    """image: [(index, x, y, w)] of every line; all boxes are 20 high."""
    out = {}
    for image, i, p, s, q in duck.execute("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem").fetchall():
        out.setdefault(image, []).append((i, p * 7 % 50 + i % 4 * shift, s * 3 % 50, float(q) + 5))
    return out


def iou(a, b):
    inter = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])) * max(0, 20 - abs(a[2] - b[2]))
    return inter / (20 * a[3] + 20 * b[3] - inter)


def test_box_queries_read_all_lines(spark):
    pred, truth = boxes(connect(), 3), boxes(connect(), 0)
    best, greedy, centre = {}, [], []
    for g in pred:
        pairs = [(iou(a, b), a[0], b[0]) for a in pred[g] for b in truth[g]]
        for x, i, _ in pairs:  # lines of an order may share a number, which the SQL also takes for one box
            best[g, i] = max(best.get((g, i), 0), round(x, 9))
        near = [(a[0], d, b[0]) for a in pred[g] for b in truth[g] if (d := math.hypot(a[1] + a[3] / 2 - b[1] - b[3] / 2, a[2] - b[2])) <= max(b[3], 20) / 2]
        for out, order in ((greedy, sorted([(i, j, x) for x, i, j in pairs if x >= 0.5], key=lambda p: (-p[2], -p[0], -p[1]))), (centre, [(i, j, d) for i, d, j in sorted(near)])):
            used_l, used_r = set(), set()
            for i, j, x in order:
                if i not in used_l and j not in used_r:
                    used_l.add(i)
                    used_r.add(j)
                    out.append((g, i, j, round(x, 9)))
    run = lambda name: entry.queries()[name](spark, SMALL)
    n = sum(map(len, pred.values()))
    assert sorted((r["image"], r["i"], r["best_iou"]) for r in run("box_iou_best").collect()) == sorted((*k, x) for k, x in best.items())
    assert sorted((r["image"], r["pred_index"], r["truth_index"], round(r["iou"], 9)) for r in run("greedy_box_match").collect()) == sorted(greedy)
    assert sorted((r["image"], r["pred_index"], r["truth_index"]) for r in run("glyph_centre_match").collect()) == sorted(x[:3] for x in centre)
    report = run("detection_prf").first()
    assert (report["tp"], report["fp"], report["fn"]) == (len(greedy), n - len(greedy), n - len(greedy))
    assert abs(report["mean_iou"] - sum(x[3] for x in greedy) / len(greedy)) < 1e-6
