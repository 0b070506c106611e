"""Likelihood of trees by pruning, simulation, optimisation and sampling: numeric kernels, one independent unit a task.

A model is a small value that closures carry.  Data are site patterns with multiplicities, never sites.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkclade.functions.stats import gamma_inverse, gamma_q, lower_to_upper_triangle
from sparkclade.sources.newick import Node, children, parse_newick, write_newick

from .trees import nni

PI_MIN, RATE_MIN, LEN_MIN, LEN_MAX = 1e-13, 1e-13, 1e-8, 3.0


@dataclass(frozen=True)
class Model:
    """Compositions and rate matrices (upper triangles) by component; nodes may name theirs, else they have number 0."""

    symbols: str = "acgt"
    compositions: tuple[tuple[float, ...], ...] = ((0.25,) * 4,)
    rates: tuple[tuple[float, ...], ...] = ((1.0,) * 6,)
    gamma_shape: float | None = None
    n_categories: int = 1
    p_invariant: float = 0.0
    relative_rate: float = 1.0
    ambiguities: tuple[tuple[str, str], ...] = ()
    node_composition: dict = field(default_factory=dict)
    node_rates: dict = field(default_factory=dict)
    rescale: bool = True


#: The order of amino acids in published rate matrices.
AMINO_ACIDS = "arndcqeghilkmfpstwyv"


def protein_model(text: str, **parameters) -> Model:
    """A model of a rate file: the lower triangle of 190 exchange rates by rows, then 20 frequencies; text after these is left out."""
    values = [float(x) for x in text.split()[:210]]
    if len(values) < 210:
        raise ValueError(f"190 rates and 20 frequencies are needed, not {len(values)} numbers")
    composition = np.array(values[190:]) / sum(values[190:])
    return Model(AMINO_ACIDS, (tuple(composition.tolist()),), (tuple(lower_to_upper_triangle(values[:190], 20)),), **parameters)


def equal_rates(symbols: str = AMINO_ACIDS, **parameters) -> Model:
    """All states alike in frequency and rate."""
    n = len(symbols)
    return Model(symbols, ((1.0 / n,) * n,), ((1.0,) * (n * (n - 1) // 2),), **parameters)


def two_parameter(kappa: float) -> tuple[float, ...]:
    """Rates of a, c, g, t with transitions ``kappa`` times transversions."""
    return (1.0, kappa, 1.0, 1.0, kappa, 1.0)


def checked(model: Model) -> Model:
    n = len(model.symbols)
    for c in model.compositions:
        if len(c) != n or abs(sum(c) - 1) > 1e-6 or min(c) < 0:
            raise ValueError(f"a composition of {n} parts that sum to 1 is needed")
    for r in model.rates:
        if len(r) != n * (n - 1) // 2 or min(r) < 0:
            raise ValueError(f"{n * (n - 1) // 2} rates are needed")
    if not 0 <= model.p_invariant < 1 or (model.n_categories > 1) != (model.gamma_shape is not None):
        raise ValueError("the share of invariant sites is from 0 to 1; several categories go with a shape")
    return model


def rate_matrix(composition, rates) -> np.ndarray:
    """Q of exchange rates and composition, scaled to one substitution."""
    pi, n = np.maximum(np.asarray(composition, float), PI_MIN), len(composition)
    r = np.zeros((n, n))
    r[np.triu_indices(n, 1)] = np.maximum(rates, RATE_MIN)
    q = (r + r.T) * pi[None, :]
    np.fill_diagonal(q, -q.sum(1))
    return q / -(pi * np.diag(q)).sum()


class Process:
    """P(t) of one composition and rate matrix, by the eigensystem of the symmetric form of Q."""

    def __init__(self, composition, rates):
        self.pi = np.maximum(np.asarray(composition, float), PI_MIN)
        root = np.sqrt(self.pi)
        s = root[:, None] * rate_matrix(composition, rates) / root[None, :]
        self.values, v = np.linalg.eigh((s + s.T) / 2)
        self.left, self.right = v / root[:, None], v.T * root[None, :]

    def p(self, t: float) -> np.ndarray:
        return np.maximum(self.left * np.exp(self.values * t)[None, :] @ self.right, 0.0)


def discrete_gamma(shape: float, n: int) -> np.ndarray:
    """Mean rates of n categories of equal probability of a gamma distribution of mean 1."""
    if n == 1:
        return np.ones(1)
    cut = [gamma_inverse(k / n, shape) for k in range(1, n)]
    upto = np.array([0.0, *(1 - gamma_q(shape + 1, x) for x in cut), 1.0])
    return np.diff(upto) * n


def tip_sets(model: Model) -> dict[str, np.ndarray]:
    """What each character may be, as 0 and 1 a state; gaps and unknowns are anything."""
    eye, n = np.eye(len(model.symbols)), len(model.symbols)
    out = {s: eye[i] for i, s in enumerate(model.symbols)}
    out |= {a: sum(eye[model.symbols.index(s)] for s in of) for a, of in model.ambiguities}
    return {**{c: np.ones(n) for c in "-?nx"}, **out}


class Likelihood:
    """Of patterns, columns in the order of ``taxa``, on trees that share these taxa."""

    def __init__(self, patterns: list[str], weights: list[float], taxa: list[str], model: Model):
        self.model, self.weights = checked(model), np.asarray(weights, float)
        sets = tip_sets(model)
        self.tips = {t: np.array([sets[p[k]] for p in patterns]).T for k, t in enumerate(taxa)}
        self.rates = discrete_gamma(model.gamma_shape, model.n_categories) if model.n_categories > 1 else np.ones(1)
        self.processes = {}
        every = np.ones((len(model.symbols), len(patterns)))
        for x in self.tips.values():
            every = every * x
        self.constant = every

    def process(self, c: int, r: int) -> Process:
        if (c, r) not in self.processes:
            self.processes[c, r] = Process(self.model.compositions[c], self.model.rates[r])
        return self.processes[c, r]

    def conditionals(self, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
        """Conditional likelihoods at the root (category x state x pattern), and the logs taken out to keep them in range."""
        m, below, done = self.model, children(nodes), {}
        logs = np.zeros(len(self.weights))
        for n in reversed(nodes):
            if not below[n.num]:
                continue
            cl = np.ones((len(self.rates), len(m.symbols), len(self.weights)))
            for c in below[n.num]:
                name = nodes[c].name if nodes[c].is_leaf else c
                proc = self.process(m.node_composition.get(name, 0), m.node_rates.get(name, 0))
                t = (nodes[c].length if nodes[c].length is not None else 0.1) * m.relative_rate / (1 - m.p_invariant)
                for k, rate in enumerate(self.rates):
                    p = proc.p(t * rate)
                    cl[k] *= p @ (self.tips[nodes[c].name] if nodes[c].is_leaf else done[c][k])
                done.pop(c, None)
            if m.rescale:
                top = cl.max((0, 1))
                top[top <= 0] = 1.0
                cl /= top
                logs += np.log(top)
            done[n.num] = cl
        return done[0], logs

    def pattern_logs(self, nodes: list[Node]) -> np.ndarray:
        cl, logs = self.conditionals(nodes)
        m = self.model
        pi = np.asarray(m.compositions[m.node_composition.get(0, 0)])
        like = (1 - m.p_invariant) * np.einsum("s,ksp->p", pi, cl) / len(self.rates)
        with np.errstate(divide="ignore"):
            out = np.log(like) + logs
            if m.p_invariant:
                out = np.logaddexp(out, np.log(m.p_invariant * (pi @ self.constant)))
        return out

    def log_like(self, nodes: list[Node]) -> float:
        logs = self.pattern_logs(nodes)
        return float(self.weights @ logs) if np.isfinite(logs).all() else -1e99


#: Trees and patterns that meet in a task: sums over patterns are taken in parts, so no task holds a whole data set.
TREES_A_TASK, PATTERNS_A_TASK = 12, 20_000


def dealt(trees: DataFrame, patterns: DataFrame, patterns_a_task: int | None = PATTERNS_A_TASK) -> tuple[DataFrame, DataFrame]:
    """Trees (tree_id, newick) and patterns (part_id, pattern, n) in blocks, each of the ones with each of the others, by
    (part, block, bucket); without a bound a part's patterns are one block."""
    size = F.ceil(F.count("*") / patterns_a_task) if patterns_a_task else F.lit(1)
    # A row a part, and a single row: what is broadcast does not grow with the data.
    blocks = patterns.groupBy("part_id").agg(size.cast("int").alias("blocks")).select(F.col("part_id").alias("part"), "blocks")
    buckets = trees.agg((F.floor(F.count("*") / TREES_A_TASK) + 1).cast("int").alias("buckets"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda by, c: F.pmod(F.xxhash64(by), F.col(c)).cast("int")
    left = trees.select("tree_id", "newick").crossJoin(F.broadcast(buckets)).crossJoin(F.broadcast(blocks))
    left = left.select("part", each("blocks").alias("block"), mine("tree_id", "buckets").alias("bucket"), "tree_id", "newick")
    right = patterns.join(F.broadcast(blocks), F.col("part_id") == F.col("part")).crossJoin(F.broadcast(buckets))
    right = right.select(F.col("part_id"), mine("pattern", "blocks").alias("of"), each("buckets").alias("to"), "pattern", "n")
    return left, right


def met(trees: DataFrame, patterns: DataFrame, f, schema: str, patterns_a_task: int | None = PATTERNS_A_TASK) -> DataFrame:
    """``f`` (part, trees, patterns) on each block of trees with each block of patterns."""
    left, right = dealt(trees, patterns, patterns_a_task)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return f(int(b["part_id"].iloc[0]), a, b) if len(a) and len(b) else pd.DataFrame({c: [] for c in names})

    return left.groupBy("part", "block", "bucket").cogroup(right.groupBy("part_id", "of", "to")).applyInPandas(run, schema)


def log_likelihoods(trees: DataFrame, patterns: DataFrame, taxa: list[str], models: dict[int, Model]) -> DataFrame:
    """(tree_id, part_id, log_like) of trees (tree_id, newick) and patterns (part_id, pattern, n)."""

    def of(part: int, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        engine = Likelihood(right["pattern"].tolist(), right["n"].tolist(), taxa, models[part])
        return pd.DataFrame([(t, part, engine.log_like(parse_newick(x))) for t, x in zip(left["tree_id"], left["newick"])], columns=["tree_id", "part_id", "log_like"])

    kind = trees.schema["tree_id"].dataType.simpleString()
    known = patterns.where(F.col("part_id").isin(*models))
    return met(trees, known, of, f"tree_id {kind}, part_id int, log_like double").groupBy("tree_id", "part_id").agg(F.sum("log_like").alias("log_like"))


def site_log_likelihoods(trees: DataFrame, patterns: DataFrame, taxa: list[str], model: Model) -> DataFrame:
    """(tree_id, pattern, ln) to be joined to sites."""

    def of(_: int, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        engine = Likelihood(right["pattern"].tolist(), right["n"].tolist(), taxa, model)
        return pd.concat([pd.DataFrame({"tree_id": t, "pattern": right["pattern"], "ln": engine.pattern_logs(parse_newick(x))}) for t, x in zip(left["tree_id"], left["newick"])])

    kind = trees.schema["tree_id"].dataType.simpleString()
    return met(trees, patterns.select(F.lit(0).alias("part_id"), "pattern", "n"), of, f"tree_id {kind}, pattern string, ln double")


# -- optimisation


def golden(f, low: float, high: float, tolerance: float = 1e-7) -> float:
    """Place of the greatest value of a function with one peak."""
    g = (5**0.5 - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tolerance * (1 + abs(low)):
        if fa > fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = f(b)
    return (low + high) / 2


def newton_pass(engine: Likelihood, nodes: list[Node], steps: int = 10) -> None:
    """Each branch's length in turn, from the root up, to the peak of the likelihood with all others held.

    What lies above a branch and what lies on its other side are known when its turn comes, so the likelihood and its two
    derivatives are products of three small matrices.
    """
    m, below = engine.model, children(nodes)
    rates, weights = engine.rates, engine.weights
    rate_scale = m.relative_rate / (1 - m.p_invariant)
    name = lambda i: nodes[i].name if nodes[i].is_leaf else i
    process = lambda i: engine.process(m.node_composition.get(name(i), 0), m.node_rates.get(name(i), 0))
    long = lambda i: 0.1 if nodes[i].length is None else nodes[i].length
    through = lambda i: np.array([process(i).p(long(i) * rate_scale * r) for r in rates])

    def in_range(x: np.ndarray) -> np.ndarray:
        top = x.max((0, 1), keepdims=True)
        return x / np.where(top > 0, top, 1.0)

    # Above: what the leaves above a node say of its state; by category, state and pattern, to a factor a pattern.
    above: dict[int, np.ndarray] = {}
    for n in reversed(nodes):
        if n.is_leaf:
            above[n.num] = np.repeat(engine.tips[n.name][None], len(rates), 0)
        else:
            above[n.num] = in_range(np.prod([through(c) @ above[c] for c in below[n.num]], 0))
    logs = engine.pattern_logs(nodes)
    pi = np.asarray(m.compositions[m.node_composition.get(0, 0)])
    still = m.p_invariant * (pi @ engine.constant) if m.p_invariant else np.zeros(len(weights))
    rest = {0: np.repeat(np.repeat(pi[None, :, None], len(rates), 0), len(weights), 2)}
    for n in nodes:
        here = {c: through(c) @ above[c] for c in below[n.num]}
        for c in below[n.num]:
            others = [here[x] for x in below[n.num] if x != c]
            side = in_range(rest[n.num] * np.prod(others, 0)) if others else rest[n.num]
            proc = process(c)
            # The likelihood is a sum of exponentials of the length, a term a category and eigenvalue.
            terms = np.einsum("ksp,se->kep", side, proc.left) * np.einsum("es,ksp->kep", proc.right, above[c])
            speed = (proc.values[None, :] * rates[:, None] * rate_scale)[:, :, None]

            def at(t: float, terms: np.ndarray = terms, speed: np.ndarray = speed) -> tuple[np.ndarray, ...]:
                e = terms * np.exp(speed * t)
                return e.sum((0, 1)), (e * speed).sum((0, 1)), (e * speed * speed).sum((0, 1))

            t = min(max(long(c), LEN_MIN), LEN_MAX)
            like = np.maximum(at(t)[0], 1e-300)
            # Invariant sites add a share that no length changes, on the scale of these terms.
            share = still * like / np.maximum(np.exp(logs) - still, 1e-300) if m.p_invariant else 0.0
            value = lambda x: float(weights @ np.log(np.maximum(at(x)[0] + share, 1e-300)))
            best = value(t)
            for _ in range(steps):
                like, first, second = at(t)
                like = np.maximum(like + share, 1e-300)
                slope = float(weights @ (first / like))
                bend = float(weights @ (second / like - (first / like) ** 2))
                step = -slope / bend if bend < 0 else np.sign(slope) * max(t, 0.01)
                new = min(max(t + step, LEN_MIN), LEN_MAX)
                while value(new) < best - 1e-12 and abs(new - t) > 1e-10:
                    new = (new + t) / 2
                gain, moved = value(new) - best, abs(new - t)
                if gain > 0:
                    t, best = new, best + gain
                if gain <= 1e-10 or moved < 1e-9:
                    break
            nodes[c].length = t
            if m.p_invariant:
                logs = engine.pattern_logs(nodes)
            here[c] = through(c) @ above[c]
            rest[c] = in_range(np.einsum("ksx,ksp->kxp", through(c), side))


def optimise(engine: Likelihood, nodes: list[Node], rounds: int = 20, tolerance: float = 1e-6) -> tuple[list[Node], Model, float]:
    """Branch lengths by Newton's method, then gamma shape and share of invariant sites, in rounds until nothing is gained."""
    nodes = [replace(n) for n in nodes]
    best = engine.log_like(nodes)
    for _ in range(rounds):
        before = best
        newton_pass(engine, nodes)
        best = engine.log_like(nodes)
        if engine.model.gamma_shape is not None:
            def shaped(x: float) -> float:
                engine.rates = discrete_gamma(float(np.exp(x)), engine.model.n_categories)
                return engine.log_like(nodes)

            x = golden(shaped, np.log(0.05), np.log(100.0), 1e-4)
            best = max(best, shaped(x))
            engine.model = replace(engine.model, gamma_shape=float(np.exp(x)))
        if engine.model.p_invariant:
            def invariant(x: float) -> float:
                engine.model = replace(engine.model, p_invariant=x)
                return engine.log_like(nodes)

            best = max(best, invariant(golden(invariant, 1e-6, 0.99, 1e-5)))
        if best - before < tolerance:
            break
    return nodes, engine.model, best


def optimised(trees: DataFrame, patterns: DataFrame, taxa: list[str], model: Model) -> DataFrame:
    """(tree_id, newick, log_like): each tree with its best lengths, a task a tree."""

    def of(_: int, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for t, x in zip(left["tree_id"], left["newick"]):
            engine = Likelihood(right["pattern"].tolist(), right["n"].tolist(), taxa, model)
            nodes, _, best = optimise(engine, parse_newick(x))
            rows.append((t, write_newick(nodes), best))
        return pd.DataFrame(rows, columns=["tree_id", "newick", "log_like"])

    kind = trees.schema["tree_id"].dataType.simpleString()
    # A peak needs all patterns of an analysis at once.
    return met(trees, patterns.select(F.lit(0).alias("part_id"), "pattern", "n"), of, f"tree_id {kind}, newick string, log_like double", None)


# -- simulation


#: Sites that are made at once: what a worker holds does not grow with an alignment's length.
SITES_AT_ONCE = 50_000


def simulated(nodes: list[Node], model: Model, n_sites: int, rng: np.random.Generator, first: int, last: int) -> dict[str, str]:
    """Sites ``first`` to before ``last`` of the ``n_sites`` that ``simulate`` makes.

    Every site has its own numbers of the generator, a PCG64: half a word for its category, then a word each for whether
    it is invariant, for its root and for each node.  All sites' words for one of these follow each other, so the others'
    are leapt over.  Categories are drawn without rejection, as numpy's are if their number is a power of two.
    """
    k, bits, many = len(model.symbols), rng.bit_generator, last - first
    rates = discrete_gamma(model.gamma_shape, model.n_categories) if model.n_categories > 1 else np.ones(1)
    category = np.zeros(many, int)
    if len(rates) > 1:
        bits.advance(first // 2)
        words = bits.random_raw((last + 1) // 2 - first // 2)
        halves = np.stack([words & 0xFFFFFFFF, words >> 32], 1).ravel()[first % 2 :][:many]
        category = (halves * len(rates) >> 32).astype(int)
        bits.advance((n_sites + 1) // 2 - (last + 1) // 2)

    def drawn(draw):
        bits.advance(first)
        out = draw(many)
        bits.advance(n_sites - last)
        return out

    still = drawn(rng.random) < model.p_invariant
    pi = model.compositions[model.node_composition.get(0, 0)]
    states = {0: drawn(lambda n: rng.choice(k, n, p=pi))}
    out, symbols = {}, np.array(list(model.symbols))
    for n in nodes[1:]:
        name = n.name if n.is_leaf else n.num
        proc = Process(model.compositions[model.node_composition.get(name, 0)], model.rates[model.node_rates.get(name, 0)])
        t = (n.length if n.length is not None else 0.1) * model.relative_rate / (1 - model.p_invariant)
        upto = np.array([np.cumsum(proc.p(t * r) / proc.p(t * r).sum(1, keepdims=True), 1) for r in rates])
        above = (drawn(rng.random)[:, None] > upto[category, states[n.parent]]).sum(1)
        own = np.where(still, states[n.parent], np.minimum(above, k - 1))
        if n.is_leaf:
            out[n.name] = "".join(symbols[own].tolist())
        else:
            states[n.num] = own
    return out


def simulate(nodes: list[Node], model: Model, n_sites: int, rng: np.random.Generator) -> dict[str, str]:
    """Sequences of the leaves, evolved from a root of the model's composition."""
    start, parts = rng.bit_generator.state, []
    for first in range(0, max(n_sites, 1), SITES_AT_ONCE):
        rng.bit_generator.state = start
        parts.append(simulated(nodes, model, n_sites, rng, first, min(first + SITES_AT_ONCE, n_sites)))
    return {name: "".join(p[name] for p in parts) for name in parts[0]}


def simulations(spark, newick: str, model: Model, n_sites: int, replicates: int, seed: int = 1) -> DataFrame:
    """(replicate, name, seq): a task some sites of a replicate; a site's random numbers depend on seed, replicate, the
    number of sites and its place only."""
    each = SITES_AT_ONCE
    blocks = max(1, -(-n_sites // each))

    def run(frames):
        nodes = parse_newick(newick)
        for f in frames:
            for r, block in (divmod(int(i), blocks) for i in f["id"]):
                seqs = simulated(nodes, model, n_sites, np.random.default_rng([seed, r]), block * each, min((block + 1) * each, n_sites))
                yield pd.DataFrame({"replicate": r, "block": block, "name": list(seqs), "seq": list(seqs.values())})

    many = replicates * blocks
    made = spark.range(0, many, 1, max(many, 1)).mapInPandas(run, "replicate long, block long, name string, seq string")
    # A sequence is one value of the result; its parts meet in built-in functions.
    parts = F.array_sort(F.collect_list(F.struct("block", "seq")))
    return made.groupBy("replicate", "name").agg(F.array_join(F.transform(parts, lambda p: p["seq"]), "").alias("seq"))


def ancestral_draw(engine: Likelihood, nodes: list[Node], rng: np.random.Generator) -> str:
    """States at the root drawn from their posterior, a pattern each."""
    cl, _ = engine.conditionals(nodes)
    w = np.asarray(engine.model.compositions[0])[:, None] * cl.sum(0)
    upto = np.cumsum(w / w.sum(0), 0)
    return "".join(engine.model.symbols[k] for k in np.minimum((rng.random(w.shape[1])[None, :] > upto).sum(0), len(w) - 1))


def expected_compositions(nodes: list[Node], model: Model) -> dict[str, np.ndarray]:
    """Composition that each leaf is expected to have, from the root's down the tree."""
    rates = discrete_gamma(model.gamma_shape, model.n_categories) if model.n_categories > 1 else np.ones(1)
    at = {0: [np.asarray(model.compositions[model.node_composition.get(0, 0)])] * len(rates)}
    out = {}
    for n in nodes[1:]:
        name = n.name if n.is_leaf else n.num
        proc = Process(model.compositions[model.node_composition.get(name, 0)], model.rates[model.node_rates.get(name, 0)])
        t = (n.length if n.length is not None else 0.1) * model.relative_rate / (1 - model.p_invariant)
        at[n.num] = [x @ proc.p(t * r) for x, r in zip(at[n.parent], rates)]
        if n.is_leaf:
            out[n.name] = (1 - model.p_invariant) * np.mean(at[n.num], 0) + model.p_invariant * at[0][0]
    return out


def composition_fit(counts: dict[str, np.ndarray], expected: dict[str, np.ndarray]) -> dict[str, float]:
    """X2 against the model's expectation, the sum of absolute differences by expectation, and mean Euclidean distance."""
    x2 = cm = ce = 0.0
    for name, o in counts.items():
        e = expected[name] * o.sum()
        x2 += float(((o - e) ** 2 / np.maximum(e, 1e-300)).sum())
        cm += float((np.abs(o - e) / np.maximum(e, 1e-300)).sum())
        ce += float(np.sqrt(((o / o.sum() - expected[name]) ** 2).sum()))
    return {"x_squared": x2, "c_m": cm, "c_e": ce / len(counts)}


def fit_tests(spark, newick: str, model: Model, observed: dict[str, str], replicates: int = 100, seed: int = 1) -> DataFrame:
    """(test, statistic, p): composition fit, and the unconstrained less the tree's log likelihood, against simulations."""
    names = sorted(observed)

    def statistics(seqs: dict[str, str]) -> dict[str, float]:
        nodes = parse_newick(newick)
        counts = {n: np.array([s.count(c) for c in model.symbols], float) for n, s in seqs.items()}
        patterns, n = np.unique(["".join(x) for x in zip(*(seqs[k] for k in names))], return_counts=True)
        free = float((n * np.log(n)).sum() - n.sum() * np.log(n.sum()))
        engine = Likelihood(patterns.tolist(), n.tolist(), names, model)
        return {**composition_fit(counts, expected_compositions(nodes, model)), "goldman_cox": free - engine.log_like(nodes)}

    own, length = statistics(observed), len(observed[names[0]])

    def run(frames):
        for f in frames:
            for r in f["id"]:
                s = statistics(simulate(parse_newick(newick), model, length, np.random.default_rng([seed, int(r)])))
                yield pd.DataFrame({"test": list(s), "value": list(s.values())})

    null = spark.range(replicates).mapInPandas(run, "test string, value double")
    at = spark.createDataFrame(list(own.items()), "test string, statistic double")
    return null.join(F.broadcast(at), "test").groupBy("test").agg(F.first("statistic").alias("statistic"), F.avg((F.col("value") >= F.col("statistic")).cast("int")).alias("p"))


# -- sampling


@dataclass
class Tuning:
    """Proposal settings, moved to keep acceptance in range during burn-in."""

    length: float = 2 * np.log(2.0)
    dirichlet: float = 500.0
    shape: float = 2 * np.log(1.5)


def log_dirichlet(x: np.ndarray, alpha: np.ndarray) -> float:
    from math import lgamma

    return lgamma(alpha.sum()) - sum(map(lgamma, alpha)) + float(((alpha - 1) * np.log(x)).sum())


def multiplied(x: float, tuning: float, low: float, high: float, rng: np.random.Generator) -> tuple[float, float]:
    """x by a random factor, reflected on the log scale; and the log of the proposal ratio."""
    y = np.log(x) + tuning * (rng.random() - 0.5)
    a, b = np.log(low), np.log(high)
    while not a <= y <= b:
        y = 2 * a - y if y < a else 2 * b - y
    return float(np.exp(y)), float(y - np.log(x))


def accepted(ln_ratio: float, rng: np.random.Generator) -> bool:
    return ln_ratio >= 0 or (ln_ratio > -100 and rng.random() < np.exp(ln_ratio))


#: Share of invariant sites at most; rows of samples that a task hands on at once.
MOST_INVARIANT, ROWS_AT_ONCE = 0.999, 10_000


class Chain:
    """One Metropolis-Hastings chain over lengths, topology, composition, rates and gamma shape."""

    def __init__(self, patterns, weights, taxa, model: Model, nodes: list[Node], rng: np.random.Generator, temperature: float = 0.0, prior: float = 10.0):
        self.engine, self.nodes, self.rng = Likelihood(patterns, weights, taxa, model), [replace(n) for n in nodes], rng
        self.data, self.beta, self.prior, self.tuning = (patterns, weights, taxa), 1 / (1 + temperature), prior, Tuning()
        self.log_like = self.engine.log_like(self.nodes)
        self.tried: dict[tuple[str, bool], int] = {}

    @property
    def ln_prior(self) -> float:
        """Log of the prior's density, but for a constant: exponential lengths and shape, the rest flat."""
        lengths = sum(n.length if n.length is not None else 0.1 for n in self.nodes[1:])
        return -self.prior * lengths - (self.engine.model.gamma_shape or 0.0)

    def step(self) -> None:
        moves = ["length"] * 6 + ["topology"] * 2 + ["composition", "rates"] + (["shape"] if self.engine.model.gamma_shape is not None else []) + (["invariant"] if self.engine.model.p_invariant else [])
        move = moves[self.rng.integers(len(moves))]
        nodes, engine, ln_prior, ln_proposal = [replace(n) for n in self.nodes], self.engine, 0.0, 0.0
        m = engine.model
        if move == "length":
            n = nodes[1 + self.rng.integers(len(nodes) - 1)]
            old = n.length if n.length is not None else 0.1
            n.length, ln_proposal = multiplied(old, self.tuning.length, LEN_MIN, LEN_MAX, self.rng)
            ln_prior = -self.prior * (n.length - old)
        elif move == "topology":
            import random

            nodes = nni(nodes, random.Random(int(self.rng.integers(1 << 62))))
        elif move == "shape":
            shape, ln_proposal = multiplied(m.gamma_shape, self.tuning.shape, 0.02, 300.0, self.rng)
            ln_prior = -(shape - m.gamma_shape)
            engine = Likelihood(*self.data, replace(m, gamma_shape=shape))
        elif move == "invariant":
            # A flat prior and a step that is as likely back: reflected at the ends.
            p = abs(m.p_invariant + 0.1 * (self.rng.random() - 0.5))
            p = p if p <= MOST_INVARIANT else 2 * MOST_INVARIANT - p
            engine = Likelihood(*self.data, replace(m, p_invariant=max(p, 1e-12)))
        else:
            old = np.asarray(m.compositions[0] if move == "composition" else m.rates[0], float)
            old = old / old.sum()
            new = np.maximum(self.rng.dirichlet(np.maximum(self.tuning.dirichlet * old, 1e-3)), 1e-6)
            new = new / new.sum()
            ln_proposal = log_dirichlet(old, self.tuning.dirichlet * new) - log_dirichlet(new, self.tuning.dirichlet * old)
            part = {"compositions": (tuple(new), *m.compositions[1:])} if move == "composition" else {"rates": (tuple(new), *m.rates[1:])}
            engine = Likelihood(*self.data, replace(m, **part))
        now = engine.log_like(nodes)
        ok = accepted(self.beta * (now - self.log_like + ln_prior) + ln_proposal, self.rng)
        self.tried[move, ok] = self.tried.get((move, ok), 0) + 1
        if ok:
            self.nodes, self.engine, self.log_like = nodes, engine, now


def exchanged(a: Chain, b: Chain, rng: np.random.Generator) -> bool:
    """Whether two chains change temperatures.  What is heated is the posterior, so priors count in the exchange as well."""
    if not accepted((a.beta - b.beta) * (b.log_like + b.ln_prior - a.log_like - a.ln_prior), rng):
        return False
    a.beta, b.beta = b.beta, a.beta
    return True


def last_samples(samples: DataFrame) -> dict[int, tuple[int, str, dict[str, float]]]:
    """By run: the last generation, its tree and its parameters; a row a run and parameter."""
    top = samples.groupBy("run").agg(F.max("gen").alias("gen"))
    out: dict[int, tuple[int, str, dict[str, float]]] = {}
    for r in samples.join(top, ["run", "gen"]).select("run", "gen", "newick", "name", "value").collect():
        out.setdefault(r.run, (r.gen, r.newick, {}))[2][r.name] = r.value
    return out


def with_values(model: Model, values: dict[str, float]) -> Model:
    """The model with parameters by the names that samples give them."""
    if not values:
        return model
    pi = np.array([values[f"comp_{s}"] for s in model.symbols])
    rates = tuple(values[f"rate_{k}"] for k in range(len(model.rates[0])))
    return replace(
        model, compositions=(tuple((pi / pi.sum()).tolist()), *model.compositions[1:]), rates=(rates, *model.rates[1:]),
        gamma_shape=values.get("shape", model.gamma_shape), p_invariant=values.get("invariant", model.p_invariant),
    )


def posterior_predictive(samples: DataFrame, model: Model, n_sites: int, seed: int = 1) -> DataFrame:
    """(run, gen, x_squared): the composition statistic of data simulated under each sample of ``mcmc``, a task some samples."""

    def of(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        run, gen = key
        own = with_values(model, dict(zip(f["name"], f["value"])))
        seqs = simulate(parse_newick(f["newick"].iloc[0]), own, n_sites, np.random.default_rng([seed, int(run), int(gen)]))
        n = np.array([[s.count(c) for c in own.symbols] for s in seqs.values()], float)
        e = n.mean(0)
        return pd.DataFrame({"run": [run], "gen": [gen], "x_squared": [float((((n - e) ** 2)[:, e > 0] / e[e > 0]).sum())]})

    return samples.groupBy("run", "gen").applyInPandas(of, "run long, gen long, x_squared double")


def mcmc(spark, patterns: list[str], weights: list[float], taxa: list[str], model: Model, newick: str, runs: int = 2, chains: int = 4, generations: int = 1000, interval: int = 10, heat: float = 0.2, seed: int = 1, resume: DataFrame | None = None) -> DataFrame:
    """(run, gen, log_like, newick, name, value): samples of the cold chain, one row a parameter; a task a run.

    Heated chains and their exchanges live in the task.  A run's random numbers depend on seed, run and first generation
    only, so a lost executor repeats it exactly.  ``resume``: samples of earlier generations; every run goes on from its
    last one, all its chains from there.
    """
    last = last_samples(resume) if resume is not None else {}
    names = ["run", "gen", "log_like", "newick", "name", "value"]

    def run(frames):
        for f in frames:
            for r in f["id"]:
                first, text, values = last.get(int(r), (0, newick, {}))
                rng = np.random.default_rng([seed, int(r), first] if first else [seed, int(r)])
                start = with_values(model, values)
                own = [Chain(patterns, weights, taxa, start, parse_newick(text), rng, heat * k) for k in range(chains)]
                rows = []
                for g in range(first + 1, first + generations + 1):
                    for c in own:
                        c.step()
                    if chains > 1:
                        i = int(rng.integers(chains - 1))
                        if exchanged(own[i], own[i + 1], rng):
                            own[i], own[i + 1] = own[i + 1], own[i]
                    if g % interval == 0:
                        cold, m = own[0], own[0].engine.model
                        values = {f"comp_{s}": p for s, p in zip(m.symbols, m.compositions[0])} | {f"rate_{k}": x for k, x in enumerate(m.rates[0])}
                        values |= {"shape": m.gamma_shape} if m.gamma_shape is not None else {}
                        values |= {"invariant": m.p_invariant} if m.p_invariant else {}
                        text = write_newick(cold.nodes)
                        rows += [(int(r), g, cold.log_like, text, k, float(x)) for k, x in values.items()]
                        if len(rows) >= ROWS_AT_ONCE:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                yield pd.DataFrame(rows, columns=names)

    return spark.range(runs, numPartitions=runs).mapInPandas(run, "run long, gen long, log_like double, newick string, name string, value double")
