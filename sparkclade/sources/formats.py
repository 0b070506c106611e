"""Readers of sequence and tree files: whole files as text, parsed in the executors, one record a sequence or tree.

``read`` chooses by suffix, else by content; nothing that is read is ever executed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclade.operators.taxon_sets import of_text

from .newick import parse_newick, split_keys
from .nexus_tokens import tokens, unquote

SUFFIXES = {"fasta": "fasta", "fas": "fasta", "fa": "fasta", "fsa": "fasta", "nex": "nexus", "nxs": "nexus", "nexus": "nexus", "phy": "phylip", "phylip": "phylip", "aln": "clustal", "gde": "gde", "pir": "pir", "nbrf": "pir", "tre": "newick", "tree": "newick", "nwk": "newick", "xml": "phyloxml", "phyloxml": "phyloxml", "jplace": "jplace"}

SEQUENCE = "file string, block int, tax_id int, name string, comment string, data_type string, seq string"
#: Trees that are Python objects at a time.
TREES_A_FRAME = 250
TREE = "file string, tree_id int, name string, weight double, rooted boolean, newick string"


@dataclass
class Parsed:
    """What a file holds: sequences (block, name, comment, seq), trees (name, weight, rooted, newick), sets (kind, name, items)."""

    sequences: list[tuple[int, str, str | None, str]] = field(default_factory=list)
    trees: list[tuple[str | None, float, bool | None, str]] = field(default_factory=list)
    sets: list[tuple[str, str, str]] = field(default_factory=list)


def data_type(seqs: list[str]) -> str:
    """dna, rna or protein: nine tenths of the letters are acgn and t or u, or nearly all are nucleotide codes and three quarters those."""
    text = "".join(seqs).lower()
    letters = [c for c in text if c.isalpha()]
    n = len(letters)
    if not n:
        return "dna"
    count = {c: letters.count(c) for c in set(letters)}
    core = sum(count.get(c, 0) for c in "acgn") + max(count.get("t", 0), count.get("u", 0))
    wide = sum(count.get(c, 0) for c in "acgtunrykmswbdhv")
    if core >= 0.9 * n or (wide >= 0.99 * n and core >= 0.75 * n):
        return "rna" if count.get("u", 0) > count.get("t", 0) else "dna"
    return "protein"


def fasta(text: str) -> Parsed:
    out = Parsed()
    for record in re.split(r"(?m)^>", text)[1:]:
        head, _, body = record.partition("\n")
        name, _, comment = head.strip().partition(" ")
        out.sequences.append((0, name, comment or None, re.sub(r"\s+", "", body)))
    return out


def pir(text: str) -> Parsed:
    """>P1;name, a line of comment, and sequence up to ``*``."""
    out = Parsed()
    for record in re.split(r"(?m)^>", text)[1:]:
        head, comment, body = (record.split("\n", 2) + ["", ""])[:3]
        out.sequences.append((0, head.partition(";")[2].strip(), comment.strip() or None, re.sub(r"\s+", "", body.partition("*")[0])))
    return out


def gde(text: str) -> Parsed:
    """Records in braces of keyword and value; sequences of type MASK are kept under their name."""
    out = Parsed()
    for record in re.findall(r"\{((?:[^{}\"]|\"[^\"]*\")*)\}", text):
        values = {k: q or w for k, q, w in re.findall(r"([\w-]+)\s+(?:\"([^\"]*)\"|(\S+))", record)}
        seq = re.sub(r"\s+", "", values.get("sequence", ""))
        out.sequences.append((0, values.get("name", ""), values.get("type"), "-" * int(values.get("offset", 0) or 0) + seq))
    return out


def clustal(text: str) -> Parsed:
    parts: dict[str, list[str]] = {}
    for line in text.splitlines()[1:]:
        if line.strip() and not line[0].isspace():
            name, seq, *_ = line.split()
            parts.setdefault(name, []).append(seq)
    return Parsed([(0, n, None, "".join(p)) for n, p in parts.items()])


def phylip(text: str) -> Parsed:
    """Sequences, sequential or interleaved, with names of ten columns or ended by white space; or Newick trees."""
    lines = [x for x in text.splitlines() if x.strip()]
    head = lines[0].split() if lines else []
    if not (len(head) >= 2 and head[0].isdigit() and head[1].isdigit()):
        return newick(text)
    n, length, body = int(head[0]), int(head[1]), lines[1:]

    def joined(rows: list[tuple[str, list[str]]]) -> Parsed | None:
        found = [(name, re.sub(r"\s+", "", "".join(p))) for name, p in rows]
        ok = len(found) == n and all(len(s) == length for _, s in found) and len({x for x, _ in found}) == n
        return Parsed([(0, name, None, s) for name, s in found]) if ok else None

    def cut(line: str, strict: bool) -> tuple[str, str]:
        if strict:
            return line[:10].strip(), line[10:]
        name, _, rest = line.strip().partition(" ")
        return name, rest

    for strict in (False, True):
        if len(body) % n == 0:
            rows = [(name, [first]) for name, first in (cut(x, strict) for x in body[:n])]
            for k, line in enumerate(body[n:]):
                rows[k % n][1].append(line)
            if found := joined(rows):
                return found
        rows, have = [], length
        for line in body:
            if have >= length:
                name, first = cut(line, strict)
                rows.append((name, [first]))
                have = 0
            else:
                first = line
                rows[-1][1].append(line)
            have += len(re.sub(r"\s+", "", first))
        if found := joined(rows):
            return found
    raise ValueError(f"no reading of this PHYLIP file gives {n} sequences of {length}")


def newick(text: str) -> Parsed:
    found = re.findall(r"(?:[^;'\[]|'(?:[^']|'')*'|\[[^\]]*\])+;", text)
    trees = [t.strip() for t in found if "(" in t]
    for t in trees:
        parse_newick(t)
    return Parsed(trees=[(f"t{k}", 1.0, None, t) for k, t in enumerate(trees)])


def nexus(text: str) -> Parsed:
    """Data, characters, trees and sets blocks; other blocks are skipped."""
    out = Parsed()
    block = 0
    for m in re.finditer(r"(?is)\bbegin\s+(\w+)\s*;(.*?)\bend(?:block)?\s*;", text):
        kind, body = m[1].lower(), m[2]
        if kind in ("data", "characters"):
            out.sequences += [(block, *s) for s in nexus_matrix(body)]
            block += 1
        elif kind == "trees":
            out.trees += nexus_trees(body)
        elif kind == "sets":
            for command in re.findall(r"(?is)\b(charset|taxset|charpartition)\s+([^;]*);", body):
                name, _, items = command[1].partition("=")
                out.sets.append((command[0].lower(), unquote(name.replace("*", "").strip().split("(")[0].strip()), " ".join(items.split())))
    return out


def nexus_matrix(body: str) -> Iterator[tuple[str, None, str]]:
    form = (re.search(r"(?is)\bformat\b(.*?);", body) or [None, ""])[1]
    interleave = bool(re.search(r"(?i)\binterleave\b(?!\s*=\s*no)", form))
    match = re.search(r"(?i)matchchar\s*=\s*(\S)", form)
    gap = re.search(r"(?i)\bgap\s*=\s*(\S)", form)
    missing = re.search(r"(?i)\bmissing\s*=\s*(\S)", form)
    length = re.search(r"(?i)\bnchar\s*=\s*(\d+)", body)
    matrix = re.search(r"(?is)\bmatrix\b(.*?);", re.sub(r"\[[^\]]*\]", "", body))
    rows: dict[str, list[str]] = {}
    name = None
    for line in (matrix[1] if matrix else "").splitlines():
        m = re.match(r"\s*('(?:[^']|'')*'|\S+)\s*(.*)", line)
        if not m:
            continue
        full = name is not None and not interleave and length and sum(map(len, rows[name])) < int(length[1])
        if full:
            rows[name].append(re.sub(r"\s+", "", line))
        else:
            name = unquote(m[1])
            rows.setdefault(name, []).append(re.sub(r"\s+", "", m[2]))
    seqs = {n: "".join(p).lower() for n, p in rows.items()}
    if match and seqs:
        first = next(iter(seqs.values()))
        seqs = {n: "".join(f if c == match[1].lower() else c for c, f in zip(s, first)) for n, s in seqs.items()}
    for n, s in seqs.items():
        if gap:
            s = s.replace(gap[1].lower(), "-")
        if missing:
            s = s.replace(missing[1].lower(), "?")
        yield n, None, s


def nexus_trees(body: str) -> Iterator[tuple[str | None, float, bool | None, str]]:
    table: dict[str, str] = {}
    if m := re.search(r"(?is)\btranslate\b(.*?);", body):
        words = [unquote(t) for t in tokens(m[1]) if t != ","]
        table = dict(zip(words[::2], words[1::2]))
    for m in re.finditer(r"(?is)\bu?tree\s+\*?\s*('(?:[^']|'')*'|[^\s=]+)\s*=\s*((?:\s*\[&[^\]]*\])*)\s*((?:[^;'\[]|'(?:[^']|'')*'|\[[^\]]*\])*;)", body):
        notes = m[2].lower()
        weight = re.search(r"\[&w\s+([\d.]+)(?:\s*/\s*([\d.]+))?\s*\]", notes)
        rooted = True if "[&r]" in notes else False if "[&u]" in notes else None
        nodes = parse_newick(m[3], table)
        from .newick import write_newick

        yield unquote(m[1]), float(weight[1]) / float(weight[2] or 1) if weight else 1.0, rooted, write_newick(nodes)


def phyloxml(text: str) -> Parsed:
    """Clades by nesting, their names and branch lengths."""
    import xml.etree.ElementTree as ET

    tag = lambda e: e.tag.rpartition("}")[2]

    def render(clade) -> str:
        kids = [render(c) for c in clade if tag(c) == "clade"]
        get = lambda n: next((c.text.strip() for c in clade if tag(c) == n and c.text), None)
        name, length = get("name"), get("branch_length") or clade.get("branch_length")
        from .nexus_tokens import quote

        return (f"({','.join(kids)})" if kids else "") + (quote(name) if name else "") + (f":{float(length):.10g}" if length else "")

    if re.search(r"<!(DOCTYPE|ENTITY)", text):
        raise ValueError("document types and entities are not read")
    trees = [render(c) + ";" for p in ET.fromstring(text).iter() if tag(p) == "phylogeny" for c in p if tag(c) == "clade"]
    return Parsed(trees=[(f"t{k}", 1.0, None, t) for k, t in enumerate(trees)])


PARSERS: dict[str, Callable[[str], Parsed]] = {"fasta": fasta, "pir": pir, "gde": gde, "clustal": clustal, "phylip": phylip, "newick": newick, "nexus": nexus, "phyloxml": phyloxml}


def sniff(text: str) -> str:
    """A file's format from its first line that isn't blank."""
    first = next((x.strip() for x in text.splitlines() if x.strip()), "")
    if first.upper().startswith("#NEXUS"):
        return "nexus"
    if re.match(r">\w\d;", first):
        return "pir"
    if first.startswith(">"):
        return "fasta"
    if first.upper().startswith("CLUSTAL"):
        return "clustal"
    if first.startswith("{"):
        return "gde"
    if first.startswith("<"):
        return "phyloxml"
    if re.match(r"\d+\s+\d+", first):
        return "phylip"
    if first.startswith("("):
        return "newick"
    raise ValueError(f"no known format begins with {first[:40]!r}")


def parse(text: str, path: str = "") -> Parsed:
    suffix = path.rpartition("/")[2].rpartition(".")[2].lower()
    kind = SUFFIXES.get(suffix)
    return PARSERS[kind if kind in PARSERS else sniff(text)](text)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): whole files; an alignment's end can change what its beginning means, so one is one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return sequences_in(_files(spark, path))


def sequences_in(files: DataFrame) -> DataFrame:
    """(file, block, tax_id, name, comment, data_type, seq) of texts (file, value), read or literal; sequences in lower case."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for file, text in zip(f["file"], f["value"]):
                found = parse(text, file).sequences
                for block in sorted({s[0] for s in found}):
                    own = [s for s in found if s[0] == block]
                    kind = data_type([s[3] for s in own])
                    rows += [(file, block, k, name, comment, kind, seq.lower()) for k, (_, name, comment, seq) in enumerate(own)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SEQUENCE.split(", ")])

    return files.select("file", "value").mapInPandas(run, SEQUENCE)


def read_trees(spark: SparkSession, path: str, skip: int = 0, most: int | None = None) -> DataFrame:
    return trees_in(_files(spark, path), skip, most)


def trees_in(files: DataFrame, skip: int = 0, most: int | None = None) -> DataFrame:
    """(file, tree_id, name, weight, rooted, newick); of each file the trees after the first ``skip``, ``most`` at most."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(file, k, *t) for file, text in zip(f["file"], f["value"]) for k, t in enumerate(parse(text, file).trees) if k >= skip and (most is None or k < skip + most)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TREE.split(", ")])

    return files.select("file", "value").mapInPandas(run, TREE)


def read_sets(spark: SparkSession, path: str) -> DataFrame:
    return sets_in(_files(spark, path))


def sets_in(files: DataFrame) -> DataFrame:
    """(file, kind, name, items) of NEXUS sets blocks."""

    def run(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame([(file, *s) for file, text in zip(f["file"], f["value"]) for s in parse(text, file).sets], columns=["file", "kind", "name", "items"])

    return files.select("file", "value").mapInPandas(run, "file string, kind string, name string, items string")


def chars_of(sequences: DataFrame) -> DataFrame:
    """(file, block, tax, pos, ch), positions from 0."""
    cells = F.posexplode(F.split("seq", "")).alias("pos", "ch")
    return sequences.select("file", "block", F.col("tax_id").alias("tax"), cells).where("ch <> ''")


def few_trees(frames: Iterator, trees: int = TREES_A_FRAME) -> Iterator:
    """Frames of at most so many rows: a tree's nodes are Python objects, and a batch may hold thousands of trees."""
    for f in frames:
        for at in range(0, len(f), trees):
            yield f.iloc[at : at + trees]


def nodes_of(trees: DataFrame) -> DataFrame:
    """The node table of ``trees`` (tree_id, newick): (tree_id, num, parent, rank, name, length, is_leaf, last)."""

    def run(frames):
        import pandas as pd

        for f in few_trees(frames):
            rows = [(t, n.num, n.parent, n.rank, n.name, n.length, n.is_leaf, n.last) for t, text in zip(f["tree_id"], f["newick"]) for n in parse_newick(text)]
            yield pd.DataFrame(rows, columns=["tree_id", "num", "parent", "rank", "name", "length", "is_leaf", "last"])

    kind = trees.schema["tree_id"].dataType.simpleString()
    return trees.select("tree_id", "newick").mapInPandas(run, f"tree_id {kind}, num int, parent int, rank int, name string, length double, is_leaf boolean, last int")


def splits_of(trees: DataFrame, taxa: list[str]) -> DataFrame:
    """(tree_id, split_key, split, br_len): a row a branch; keys as longs for up to 62 taxa, as arrays of longs beyond.

    The two branches at a bifurcating root are one split: its lengths add up and it counts once.
    """
    order = {n: i for i, n in enumerate(taxa)}

    def run(frames):
        import pandas as pd

        from .newick import split_text

        for f in few_trees(frames):
            rows = []
            for t, text in zip(f["tree_id"], f["newick"]):
                found: dict[int, float | None] = {}
                for _, _, key, length in split_keys(parse_newick(text), order):
                    found[key] = length if found.get(key) is None else found[key] + (length or 0.0)
                rows += [(t, split_text(k, len(order)), x) for k, x in found.items()]
            yield pd.DataFrame(rows, columns=["tree_id", "split", "br_len"])

    kind = trees.schema["tree_id"].dataType.simpleString()
    found = trees.select("tree_id", "newick").mapInPandas(run, f"tree_id {kind}, split string, br_len double")
    return found.select("tree_id", of_text(F.col("split"), len(taxa)).alias("split_key"), "split", "br_len")


def clades_of(trees: DataFrame, taxa: list[str]) -> DataFrame:
    """(tree_id, split_key): the clades of rooted trees (tree_id, newick) of up to 61 taxa, a bit a taxon."""
    order = {n: i for i, n in enumerate(taxa)}

    def run(frames):
        import pandas as pd

        for f in few_trees(frames):
            rows = []
            for t, text in zip(f["tree_id"], f["newick"]):
                nodes = parse_newick(text)
                bits = [1 << order[n.name] if n.is_leaf else 0 for n in nodes]
                rows += [(t, sum(bits[n.num : n.last + 1])) for n in nodes[1:]]
            yield pd.DataFrame(rows, columns=["tree_id", "split_key"])

    kind = trees.schema["tree_id"].dataType.simpleString()
    return trees.select("tree_id", "newick").mapInPandas(run, f"tree_id {kind}, split_key long").distinct()


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    return distances_in(_files(spark, path))


def distances_in(files: DataFrame) -> DataFrame:
    """(file, i, j, name_i, name_j, d) of square PHYLIP distance files."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = []
            for file, text in zip(f["file"], f["value"]):
                words = text.split()
                n = int(words[0])
                table = [words[1 + k * (n + 1) : 1 + (k + 1) * (n + 1)] for k in range(n)]
                rows += [(file, i, j, table[i][0], table[j][0], float(table[i][1 + j])) for i in range(n) for j in range(n)]
            yield pd.DataFrame(rows, columns=["file", "i", "j", "name_i", "name_j", "d"])

    return files.select("file", "value").mapInPandas(run, "file string, i int, j int, name_i string, name_j string, d double")


def read_numbers(spark: SparkSession, path: str, column: int = 0, skip: int = 0) -> DataFrame:
    """(value): one column of white-space-separated text, after ``skip`` lines of each file."""
    return numbers_in(_files(spark, path), column, skip) if skip else numbers_of(spark.read.text(path), column)


def numbers_in(files: DataFrame, column: int = 0, skip: int = 0) -> DataFrame:
    """(value) of texts (file, value)."""
    lines = files.select(F.posexplode(F.split("value", "\n")).alias("k", "value")).where(F.col("k") >= skip)
    return numbers_of(lines.select("value"), column)


def numbers_of(lines: DataFrame, column: int = 0) -> DataFrame:
    """(value) of lines (value); blank ones are passed over."""
    lines = lines.select(F.col("value").alias("line")).where(F.trim("line") != "")
    return lines.select(F.get(F.split(F.trim("line"), r"\s+"), F.lit(column)).cast("double").alias("value"))


def jplace_heat(placements: DataFrame) -> DataFrame:
    """(edge, heat): of ``placements`` (query, edge, ratio), ratios made to sum to 1 a query and summed by edge."""
    from pyspark.sql import Window

    share = F.col("ratio") / F.sum("ratio").over(Window.partitionBy("query"))
    return placements.withColumn("share", share).groupBy("edge").agg(F.sum("share").alias("heat"))


def read_jplace(spark: SparkSession, path: str) -> DataFrame:
    return placements_in(_files(spark, path))


def placements_in(files: DataFrame) -> DataFrame:
    """(query, edge, ratio) of jplace files, by their own list of fields."""
    schema = "struct<fields: array<string>, placements: array<struct<p: array<array<double>>, n: array<string>>>>"
    doc = files.select("file", F.from_json("value", schema).alias("j"))
    at = lambda n: F.array_position("j.fields", n).cast("int") - 1
    each = doc.select("file", at("edge_num").alias("e"), at("like_weight_ratio").alias("r"), F.posexplode("j.placements").alias("k", "placement"))
    rows = each.select(F.concat_ws(":", "file", F.col("k").cast("string")).alias("query"), "e", "r", F.explode("placement.p").alias("p"))
    return rows.select("query", F.get("p", F.col("e")).cast("long").alias("edge"), F.get("p", F.col("r")).alias("ratio"))
