"""Large tree files: the same trees however many parts a file is read in, and by number through the index."""

import random

import pytest

from sparkclade.sources import tree_files
from sparkclade.sources.newick import parse_newick


def nexus(rng, n):
    """Trees over several lines, with semicolons and brackets in comments and quotes, and two blocks of trees."""
    names, told = dict(zip("1234", ["A;b", "B", "C's [x;", "D"])), []
    out = ["#NEXUS", "[a comment; with 'odd [nested;] things]", "begin trees;", "  translate", "    1 'A;b',", "    2 B, 3 'C''s [x;',", "    4 D", "  ;"]
    for k in range(n):
        if k == n // 2:
            names = dict(zip("1234", ["P", "Q", "R", "S;"]))
            out += ["end;", "begin trees; [other names]", "translate 1 P, 2 Q, 3 R, 4 'S;'", ";"]
        a, b, c, d = rng.sample("1234", 4)
        note = rng.choice(["", "[&U] ", "[&R] [&W 1/3] ", "[; (] ", "[&W 0.5]"])
        gap = rng.choice([" ", "\n   ", "\t"])
        inner = rng.choice(["", "[c;c]", "[" + "long comment; " * rng.randint(1, 40) + "]"])
        out.append(f"tree{gap}'t;{k}'\n= {note}(({a}:0.{k % 9 + 1},{gap}{b}){inner},{c},\n{d});")
        told.append((f"t;{k}", 1 / 3 if "1/3" in note else 0.5 if "0.5" in note else 1.0, True if "&R" in note else False if "&U" in note else None, [names[x] for x in (a, b, c, d)]))
    return "\n".join([*out, "end;", ""]), told


@pytest.fixture
def parts(spark):
    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_same_trees_in_any_parts(spark, tmp_path, parts):
    rng = random.Random(3)
    text, told = nexus(rng, 60)
    (tmp_path / "a.nex").write_text(text)
    (tmp_path / "b.nwk").write_text("[x; y]\n(A,B,(C,'D;'\n:0.1));\n(A[;],C,B);(A,B)")
    parts(1 << 30)
    whole = sorted(map(tuple, tree_files.read_trees(spark, str(tmp_path)).collect()))
    assert len(whole) == 63
    # Each command begins and ends where the file says.
    rows = tree_files.commands(spark, str(tmp_path / "a.nex")).collect()
    assert all(text[r.offset :].startswith(bytes(r.text).decode() + ";") for r in rows)
    assert [k for _, k in sorted((r.offset, r.kind) for r in rows)] == ["begin", "translate", *["tree"] * 30, "end", "begin", "translate", *["tree"] * 30, "end"]
    mine = [r for r in whole if r[0].endswith("a.nex")]
    assert [(r[1], *r[2:5], [n.name for n in parse_newick(r[5]) if n.is_leaf]) for r in mine] == [(k, *t) for k, t in enumerate(told)]
    assert [r[5] for r in whole if r[0].endswith("b.nwk")] == ["(A,B,(C,'D;' :0.1));", "(A[;],C,B);", "(A,B);"]
    for size in (300, 3000):
        parts(size)
        assert sorted(map(tuple, tree_files.read_trees(spark, str(tmp_path)).collect())) == whole
    parts(1500)
    some = tree_files.read_trees(spark, str(tmp_path), skip=2, most=40)
    assert sorted(map(tuple, some.collect())) == [r for r in whole if 2 <= r[1] < 42]


def test_comment_over_many_parts(spark, tmp_path, parts):
    (tmp_path / "a.nwk").write_text("(A,B);\n[" + "; (x,y); ' " * 500 + "]\n(A,(B[" + ";" * 700 + "],C));\n('" + ";" * 300 + "',D);")
    for size in (1 << 20, 250):
        parts(size)
        got = {r.number: r.newick for r in tree_files.read_trees(spark, str(tmp_path / "a.nwk")).collect()}
        assert len(got) == 3 and got[0] == "(A,B);" and got[2] == "('" + ";" * 300 + "',D);"


def test_index(spark, tmp_path, parts):
    rng = random.Random(4)
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.nex").write_text(nexus(rng, 60)[0])
    (tmp_path / "in" / "c.nwk").write_text("(A,B);(A,\nC)")
    parts(1500)
    whole = sorted(map(tuple, tree_files.read_trees(spark, str(tmp_path / "in")).collect()))
    index = str(tmp_path / "index")
    tree_files.write_index(spark, str(tmp_path / "in"), index, 7)
    tree_files.register(spark)
    read = lambda: spark.read.format("trees").load(index)
    assert sorted(map(tuple, read().collect())) == whole
    assert sorted(map(tuple, read().where("number in (3, 31)").collect())) == [r for r in whole if r[1] in (3, 31)]
    file = whole[0][0]
    few = read().where(f"number >= 20 and number < 24 and file = '{file}'")
    assert sorted(map(tuple, few.collect())) == [r for r in whole if 20 <= r[1] < 24 and r[0] == file]
    assert few.rdd.getNumPartitions() <= 2 < read().rdd.getNumPartitions()


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty").write_text("")
    (tmp_path / "data.nex").write_text("#NEXUS\nbegin data;\ndimensions ntax=2 nchar=3;\nmatrix\nA acg\nB a-t\n;\nend;\n")
    assert tree_files.read_trees(spark, str(tmp_path)).count() == 0
    assert {r.kind for r in tree_files.commands(spark, str(tmp_path / "data.nex")).collect()} == {"begin", "other", "end"}
