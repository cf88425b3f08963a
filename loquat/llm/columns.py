"""A caller's columns under names of the operators' own, so that no name can clash.

Operators work on ``c0, c1, ...`` and add columns whose names begin with an underscore. At the end every
column of the caller has its name again, in its place; one that has the name of an added column (in any
case, as Spark resolves names) comes out with ``_in`` behind it, as often as it takes to be free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


class Carried:
    """``df``: the caller's rows; calling gives the name there of one of the caller's columns. ``kept`` columns keep theirs."""

    def __init__(self, df: DataFrame, *kept: str):
        self.names = df.columns
        self.own = [f"c{k}" for k in range(len(self.names))]
        for name in kept:
            self.own[self._place(name)] = name
        self.df = df.toDF(*self.own)

    def _place(self, name: str) -> int:
        for same in (lambda x: x == name, lambda x: x.lower() == name.lower()):
            places = [k for k, x in enumerate(self.names) if same(x)]
            if len(places) == 1:
                return places[0]
        raise ValueError(f"{'no' if not places else 'more than one'} column {name} in {self.names}")

    def __call__(self, name: str) -> str:
        return self.own[self._place(name)]

    def back(self, out: DataFrame, *added: str) -> DataFrame:
        """``out``'s columns of the caller, named as they were, then ``added``."""
        theirs, names = {x.lower() for x in added}, []
        taken = theirs | {x.lower() for x in self.names}
        for name in self.names:
            if name.lower() in theirs:
                while name.lower() in taken:
                    name += "_in"
                taken.add(name.lower())
            names.append(name)
        return out.select(*self.own, *added).toDF(*names, *added)
