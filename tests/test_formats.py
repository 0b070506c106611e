"""Readers, writers and tree functions on small texts with known answers."""

import random

import pytest

from sparkclade.functions.genetic_code import meaning
from sparkclade.operators import trees as tr
from sparkclade.sources import formats, writers
from sparkclade.sources.newick import parse_newick, split_keys, split_text, write_newick


def test_newick_round_trip():
    for text in ("(A:0.1,(B:0.2,C:0.3)90:0.05,'D d':1);", "((a,b),c);", "(A,B,(C,D)x)root;", "('it''s',b);"):
        assert write_newick(parse_newick(text)) == text


@pytest.mark.parametrize("bad", ["(A,B", "(A,B));", "A,B;", "(A B,C);", ""])
def test_newick_refuses(bad):
    with pytest.raises(ValueError):
        parse_newick(bad)


def test_split_key_golden():
    nodes = parse_newick("((A,D),B,(C,E));")
    raw = {r: k for _, r, k, _ in split_keys(nodes, {t: i for i, t in enumerate("ABCDE")})}
    assert raw[9] == 22 and split_text(22, 5) == ".**.*"


def test_nexus_with_everything():
    text = """#NEXUS
begin data;
 dimensions ntax=3 nchar=8;
 format datatype=dna gap=~ missing=! matchchar=. interleave;
 matrix [a comment]
 one  acgt
 'two x' ..~.
 three !...

 one  tttt
 'two x' ....
 three a...
 ;
end;
begin trees;
 translate 1 one, 2 'two x', 3 three;
 tree t1 = [&W 1/4] [&U] (1:0.1,2:0.2,3:0.3);
end;
begin sets;
 charset first = 1-4\\2;
end;"""
    p = formats.parse(text, "x.nex")
    assert [(n, s) for _, n, _, s in p.sequences] == [("one", "acgttttt"), ("two x", "ac-ttttt"), ("three", "?cgtattt")]
    assert p.trees == [("t1", 0.25, False, "(one:0.1,'two x':0.2,three:0.3);")]
    assert p.sets == [("charset", "first", "1-4\\2")]


def test_sequence_formats():
    want = [("a", "acgt"), ("b", "ac-t")]
    texts = {
        "fasta": ">a x y\nac\ngt\n>b\nac-t\n", "phy": "2 4\na acgt\nb ac-t\n", "aln": "CLUSTAL W\n\na   ac\nb   ac\n\na   gt\nb   -t\n",
        "gde": '{\nname "a"\ntype "DNA"\nsequence "acgt"\n}\n{\nname "b"\ntype "DNA"\nsequence "ac-t"\n}', "pir": ">D1;a\ncomment\nacgt*\n>D1;b\n\nac-t*\n",
    }
    for suffix, text in texts.items():
        assert [(n, s) for _, n, _, s in formats.parse(text, f"f.{suffix}").sequences] == want, suffix
        assert [(n, s) for _, n, _, s in formats.parse(text).sequences] == want, suffix
    inter = "2 8\na acgt\nb acg-\n\ntttt\naaaa\n"
    assert [s for _, _, _, s in formats.phylip(inter).sequences] == ["acgttttt", "acg-aaaa"]
    with pytest.raises(ValueError):
        formats.phylip("2 8\na acgt\nb acgt\n")
    assert formats.data_type(["acgtnacg"]) == "dna" and formats.data_type(["mkvlarndce"]) == "protein" and formats.data_type(["acguacgu"]) == "rna"


def test_phyloxml():
    text = '<phyloxml><phylogeny><clade><clade><name>a</name><branch_length>0.1</branch_length></clade><clade branch_length="0.2"><name>b</name></clade></clade></phylogeny></phyloxml>'
    assert formats.parse(text).trees[0][3] == "(a:0.1,b:0.2);"


def test_genetic_code_golden():
    assert [meaning(c) for c in "gga ggy ray ggn aam sar ccm".split()] == list("ggbgxzp")
    assert meaning("tgr", 1) == "x" and meaning("tgr", 2) == "w" and meaning("---") == "-"


def test_tree_surgery():
    t = parse_newick("(A:1,B:1,(C:1,(D:1,E:1):1):1);")
    names = lambda n: sorted(x.name for x in n if x.is_leaf)
    keys = lambda n: {k for _, _, k, _ in split_keys(n, {x: i for i, x in enumerate("ABCDE")})}
    total = lambda n: sum(x.length or 0 for x in n[1:])
    for at in [n.num for n in t[1:] if not n.is_leaf]:
        again = tr.reroot(t, at)
        assert keys(again) == keys(t) and abs(total(again) - total(t)) < 1e-9
    rooted = tr.root_on_branch(t, tr.find(t, "A"))
    assert len(tr.children(rooted)[0]) == 2 and abs(total(rooted) - total(t)) < 1e-9 and keys(rooted) == keys(t)
    assert len(tr.children(tr.remove_root(rooted))[0]) == 3
    assert write_newick(tr.remove_leaves(t, {"D"})) == "(A:1,B:1,(C:1,E:2):1);"
    assert write_newick(tr.collapse(t, t[tr.find(t, "D")].parent)) == "(A:1,B:1,(C:1,D:1,E:1):1);"
    assert names(tr.add_leaf(t, tr.find(t, "B"), "F", 0.5)) == list("ABCDEF")
    assert len(tr.all_bi_rooted(t)) == 7
    rng = random.Random(1)
    for _ in range(20):
        assert names(tr.nni(t, rng)) == names(tr.random_spr(t, rng)) == list("ABCDE")
        r = tr.random_tree(list("ABCDEFGH"), rng, clades=(frozenset("BC"), frozenset("BCD")))
        k = {k for _, _, k, _ in split_keys(r, {x: i for i, x in enumerate("ABCDEFGH")})}
        assert {6, 14} <= k and len(k) == 13
    resolved = tr.resolve(parse_newick("(A,B,C,D,(E,F,G));"), rng)
    assert all(len(c) in (0, 2, 3) for c in tr.children(resolved)) and len(tr.children(resolved)[0]) == 3
    assert write_newick(tr.ladderize(parse_newick("((A,B,C),D,(E,F));")), False) == "(D,(E,F),(A,B,C));"
    lined = tr.line_up_leaves(t)
    depth = [0.0] * len(lined)
    for n in lined[1:]:
        depth[n.num] = depth[n.parent] + n.length
    assert {round(depth[n.num], 9) for n in lined if n.is_leaf} == {1.0}
    assert names(tr.restore_duplicates(t, {"A": ["A2"]})) == ["A", "A2", "B", "C", "D", "E"]
    cut, gone = tr.remove_omnipresent_cherries([t, parse_newick("((D,E),A,(B,C));")])
    assert gone == {"E": "D"} and all("E" not in names(x) for x in cut)
    assert len(tr.text_drawing(t)) == len(t)


def test_aho_and_closure():
    assert tr.aho_build({("A", "B", "C"), ("A", "B", "D"), ("C", "D", "A")}, set("ABCD")) == "((A,B),(C,D))"
    assert tr.aho_build({("A", "B", "C"), ("B", "C", "A"), ("A", "C", "B")}, set("ABC")) is None
    f = frozenset
    closed = tr.quartet_closure({(f("ab"), f("cd")), (f("ab"), f("ce"))})
    assert (f("ab"), f("de")) in closed


def test_files_to_tables_and_back(spark, tmp_path):
    (tmp_path / "a.nex").write_text("#NEXUS\nbegin data;\ndimensions ntax=2 nchar=4;\nformat datatype=dna;\nmatrix\nx acgt\ny ac-t\n;\nend;\nbegin trees;\ntree one = (x:0.5,y:0.25,z:1);\ntree two = ((x,y),z,w);\nend;")
    (tmp_path / "b.fasta").write_text(">q\nAC\nGT\n")
    s = formats.read_sequences(spark, str(tmp_path))
    assert {(r.name, r.seq) for r in s.collect()} == {("x", "acgt"), ("y", "ac-t"), ("q", "acgt")}
    assert formats.chars_of(s).count() == 12
    t = formats.read_trees(spark, str(tmp_path / "a.nex"))
    assert t.count() == 2 and formats.read_trees(spark, str(tmp_path / "a.nex"), skip=1).first().name == "two"
    nodes = formats.nodes_of(t)
    assert {(r.tree_id, r.length) for r in tr.tree_length(nodes).collect()} == {(0, 1.75), (1, None)}
    d = {(r.a, r.b): r.d for r in tr.patristic_distances(nodes.where("tree_id = 0")).collect()}
    assert d == {("x", "y"): 0.75, ("x", "z"): 1.5, ("y", "z"): 1.25}
    assert {(r.a, r.b, r.outside) for r in tr.triplets(nodes.where("tree_id = 1")).collect()} >= {("x", "y", "z"), ("x", "y", "w")}
    shape = {r.tree_id: (r.bifurcating, r.tri_root) for r in tr.shapes(nodes).collect()}
    assert shape == {0: (True, True), 1: (True, True)}
    k = {r.split for r in formats.splits_of(t.where("tree_id = 1"), ["z", "w", "x", "y"]).collect()}
    assert k == {".*..", "..*.", "...*", "..**", ".***"}
    seqs = s.where("file like '%.nex'").select("tax_id", "name", "seq")
    for lines, suffix in ((writers.nexus(seqs), "nex"), (writers.fasta(seqs, 3), "fasta"), (writers.phylip(seqs, True, 3), "phy"), (writers.phylip(seqs), "phy")):
        text = "\n".join(r.value for r in lines.orderBy("k").collect())
        assert [(n, q) for _, n, _, q in formats.parse(text, f"o.{suffix}").sequences] == [("x", "acgt"), ("y", "ac-t")], text
    trees = t.select(t.tree_id.cast("long").alias("tree_id"), "name", "weight", "newick")
    text = "\n".join(r.value for r in writers.trees_nexus(trees, ["x", "y", "z", "w"]).orderBy("k").collect())
    assert [x[3] for x in formats.parse(text, "t.nex").trees] == [r.newick for r in t.orderBy("tree_id").collect()]


def test_jplace_and_distances(spark, tmp_path):
    (tmp_path / "p.jplace").write_text('{"fields": ["edge_num", "like_weight_ratio"], "placements": [{"p": [[3, 0.6], [4, 0.2]], "n": ["a"]}, {"p": [[3, 1.0]], "n": ["b"]}]}')
    heat = {r.edge: round(r.heat, 9) for r in formats.jplace_heat(formats.read_jplace(spark, str(tmp_path / "p.jplace"))).collect()}
    assert heat == {3: 1.75, 4: 0.25}
    (tmp_path / "d.phy").write_text("2\nx 0 0.5\ny 0.5 0\n")
    d = formats.read_distances(spark, str(tmp_path / "d.phy"))
    assert {(r.name_i, r.name_j, r.d) for r in d.collect()} == {("x", "x", 0.0), ("x", "y", 0.5), ("y", "x", 0.5), ("y", "y", 0.0)}
    assert [r.value for r in writers.distances_phylip(d).orderBy("k").collect()] == ["2", "x 0.000000 0.500000", "y 0.500000 0.000000"]


def test_trees_are_read_a_few_at_a_time(spark, monkeypatch):
    """A batch of trees is not held as nodes at once: what Python hands on comes in small frames, of all trees."""
    import pandas as pd

    from sparkclade.sources import formats

    frame = pd.DataFrame({"tree_id": range(1001), "newick": "((a,b),c,d);"})
    got = list(formats.few_trees(iter([frame, frame[:0]])))
    assert max(map(len, got)) <= formats.TREES_A_FRAME and pd.concat(got).equals(frame)
    trees = spark.range(1001).selectExpr("id as tree_id", "'((a,b),c,d);' as newick").coalesce(1)
    assert formats.nodes_of(trees).count() == 6 * 1001
    assert formats.splits_of(trees, list("abcd")).count() == 5 * 1001
