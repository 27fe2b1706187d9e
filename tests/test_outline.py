"""Tables of aligned columns and indented lines, with what is neither."""

import random
import re

from convlake.operators import outline as O

PS = """
NAME      READY   STATUS    AGE
web-1     1/1     Running   5d

db-0      0/1     Error     2h (restarted 3 times)
job                 Done
"""


def tables(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, body string")
    out = {}
    for r in sorted(O.column_tables(df, "k", "body").collect(), key=lambda r: (r.k, r.line_no)):
        out.setdefault(r.k, []).append((r.line_no, r.cells, r.n_columns))
    return out


def test_column_tables(spark):
    found = tables(
        spark, PS, "A  B  C\n1  2  3\n4  5  6", "A  B  C\n1  2  3", "a  b  c\n1  2  3\n4  5  6", "A  B\n1  2\n3  4", "NAME  OF  THINGS\nprose that goes on without gaps\nand on and on", None, "",
        "  ID   ID   NAME\n  1    2    x y\n  300  4", "NAME  VALUE  NOTE\nverylongname  1  x\nb     2      y", "PORT(S)  CPU %  A_B\n80       5      é\n81       66     日 x",
    )
    assert 0 not in found and tables(spark, PS.replace("job                 Done\n", ""))[0] == [(2, ["web-1", "1/1", "Running", "5d"], 4), (4, ["db-0", "0/1", "Error", "2h (restarted 3 times)"], 4)]
    assert found[1] == [(1, ["1", "2", "3"], 3), (2, ["4", "5", "6"], 3)]
    assert not {2, 3, 4, 5, 6, 7} & set(found)
    assert found[8] == [(1, ["1", "2", "x y"], 3), (2, ["300", "4", ""], 3)]
    assert [c for _, c, _ in found[9]] == [["verylongname", "1  x"], ["b     2", "y"]]  # the second border does not hold in every line
    assert [c for _, c, _ in found[10]] == [["80", "5", "é"], ["81", "66", "日 x"]]


def test_a_row_with_too_few_fields_is_no_table(spark):
    assert set(tables(spark, PS, PS.replace("job                 Done\n", ""), PS.replace("job                 Done", "job       0/1     Done"))) == {1, 2}


def test_ancestors(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["", "  ", " " * rng.randint(0, 9) + "x"]) for _ in range(rng.randint(0, 60))) for _ in range(20)] + [None, "", "a", "\n".join(" " * i + "x" for i in range(300)), "x\n" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, body string")
    found = {}
    for r in O.line_ancestors(df, "k", "body").collect():
        found.setdefault(r.k, {})[r.line_no] = (r.indent, r.ancestors)
    for k, text in enumerate(texts[:24]):
        lines = (text or "").split("\n")
        indent = {i: len(re.match(" *", x)[0]) for i, x in enumerate(lines) if x.strip()}
        expected = {}
        for i in indent:
            parent = max((j for j in indent if j < i and indent[j] < indent[i]), default=None)
            expected[i] = (indent[i], [] if parent is None else [*expected[parent][1], parent])
        assert found.get(k, {}) == expected
    assert len(found[24]) == 50_000
