"""Small Python programs by seed, from a grammar of our own: calls that ask for keys among calls that don't.

The program of a seed is the same on every run and in every task; what Python
does not compile is drawn again. Option sets are drawn by the same seed.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tessella.session import ship
from tessella.sources.options import Options

WORDS = "user menu main title help start stop order item price name count page back next error".split()


def options(seed: int) -> Options:
    """A random set of names, prefixes and ignored arguments."""
    rng = random.Random(f"options {seed}")
    base = Options()
    names = rng.choice([base.names, base.names | {"tr"}, frozenset({"locale"})])
    return Options(names=names, prefixes=rng.choice([base.prefixes, frozenset({"self", "cls"})]), ignore_kwargs=base.ignore_kwargs | set(rng.sample(["when", "trim"], rng.randrange(3))))


def _value(rng: random.Random, deep: int, o: Options) -> str:
    pick = rng.randrange(6 if deep < 2 else 4)
    if pick == 0:
        return repr("-".join(rng.sample(WORDS, 2)))
    if pick == 1:
        return str(rng.randrange(100))
    if pick == 2:
        return f"{rng.choice(WORDS)}.{rng.choice(WORDS)}"
    if pick == 3:
        return f"[{rng.randrange(9)}, {rng.choice(WORDS)!r}]"
    return _call(rng, deep + 1, o) if pick == 4 else f"{rng.choice(WORDS)}({_value(rng, deep + 1, o)})"


def _call(rng: random.Random, deep: int, o: Options) -> str:
    root = rng.choice(sorted(o.names))
    if o.prefixes and rng.random() < 0.2:
        root = f"{rng.choice(sorted(o.prefixes))}.{root}"
    args = [f"{w}={_value(rng, deep + 1, o)}" for w in rng.sample([*WORDS, *sorted(o.ignore_kwargs)], rng.randrange(4))]
    if rng.random() < 0.1:
        args.append(f"_path={rng.choice(WORDS)!r}")
    if rng.random() < 0.1:
        args.append(f"**{rng.choice(WORDS)}")
    shape = rng.randrange(4)
    if shape == 0:
        return f"{root}({', '.join([repr('-'.join(rng.sample(WORDS, 2))), *args])})"
    if shape == 1:
        return f"{root}.get({', '.join([repr('-'.join(rng.sample(WORDS, 2))), *args])})"
    if shape == 2:
        return f"{root}.get({', '.join([rng.choice(WORDS), *args])})"
    return f"{root}.{'.'.join(rng.sample(WORDS, rng.randrange(1, 4)))}({', '.join(args)})"


def program(seed: int, o: Options | None = None) -> str:
    o = o or options(seed)
    for again in range(100):
        rng = random.Random(f"program {seed} {again}")
        lines = [f"def {rng.choice(WORDS)}({', '.join(rng.sample(WORDS, rng.randrange(3)))}):"]
        for _ in range(rng.randrange(1, 8)):
            what = rng.randrange(4)
            made = _call(rng, 0, o) if what < 2 else _value(rng, 0, o)
            lines.append(f"    {rng.choice(WORDS)} = {made}" if what % 2 else f"    print({made})")
        text = "\n".join(lines) + "\n"
        try:
            compile(text, "<made>", "exec")
        except SyntaxError:
            continue
        return text
    raise ValueError(f"no program for seed {seed}")


def corpus(seeds: DataFrame, seed: str, o: Options | None = None) -> DataFrame:
    """(file_idx, path, text, error): a program for each row's seed."""
    ship(seeds.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch[seed]
            yield pd.DataFrame({"file_idx": ids.astype("int32"), "path": [f"app/f{i}.py" for i in ids], "text": [program(int(i), o) for i in ids], "error": pd.Series([None] * len(ids), dtype=object)})

    return seeds.select(seed).mapInPandas(run, "file_idx int, path string, text string, error string")
