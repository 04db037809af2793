"""The few spellings in which the two SQL engines differ; rules are written once on top of them."""

from __future__ import annotations

from collections.abc import Callable


class Dialect:
    name = ""

    def lit(self, s: str) -> str:
        raise NotImplementedError

    def sub(self, x: str, pattern: str, by: str = "") -> str:
        """Every match replaced; groups are written $1."""
        raise NotImplementedError

    def get(self, x: str, pattern: str, group: int = 1) -> str:
        """A group of the first match, or the empty string."""
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def trim(self, x: str, pattern: str, side: str, chars: str) -> str:
        """The matches of a pattern of edge characters removed; side and chars say the same without a pattern."""
        return self.sub(x, pattern)

    def drop(self, x: str, pattern: str, chars: str) -> str:
        """The characters of a class removed; pattern matches one of them, chars names them all."""
        return self.sub(x, pattern)

    def among(self, x: str, others: str, chars: str) -> str:
        """How many characters of x are among chars; others matches one of the rest."""
        return f"length({self.sub(x, others)})"

    def squeeze(self, x: str, pattern: str, chars: str) -> str:
        """Runs of white space as one blank each; pattern matches one character of it, chars names them all."""
        return self.sub(x, f"{pattern}+", " ")

    def let(self, value: str, var: str, to: Callable[[str], str]) -> str:
        """An expression of a value that occurs in it more than once."""
        return to(value)

    def has(self, x: str, pattern: str) -> str:
        raise NotImplementedError

    def size(self, x: str) -> str:
        raise NotImplementedError

    def bytes(self, x: str) -> str:
        raise NotImplementedError

    def split(self, x: str, by: str) -> str:
        raise NotImplementedError

    def keep(self, array: str, var: str, test: str) -> str:
        raise NotImplementedError

    def each(self, array: str, var: str, to: str) -> str:
        raise NotImplementedError

    def join(self, array: str, by: str) -> str:
        raise NotImplementedError

    def slice(self, array: str, start: int, n: int) -> str:
        raise NotImplementedError

    def explode(self, source: str, keys: str, array: str, item: str = "line") -> str:
        """Rows (keys, pos from 0, item) of an array expression over a source."""
        raise NotImplementedError

    def ordered(self, value: str, by: str, sep: str) -> str:
        """Aggregate: values joined in the order of an integer column; nulls are left out."""
        raise NotImplementedError


class Spark(Dialect):
    name = "spark"

    def lit(self, s):
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def sub(self, x, pattern, by=""):
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)})"

    def trim(self, x, pattern, side, chars):
        return f"trim({side} {self.lit(chars)} FROM {x})"  # looks at the edges only

    def drop(self, x, pattern, chars):
        return f"translate({x}, {self.lit(chars)}, '')"  # a replaced match costs a microsecond, a looked up character much less

    def among(self, x, others, chars):
        return f"(length({x}) - length({self.drop(x, '', chars)}))"

    def squeeze(self, x, pattern, chars):
        # with blanks alone left, a tab and a line feed are free to stand for the edges of a run
        blanks = f"translate({x}, {self.lit(chars)}, {self.lit(' ' * len(chars))})"
        edges, turned = self.lit("\t\n"), self.lit("\n\t")
        return f"replace(replace(replace({blanks}, ' ', {edges}), {turned}, ''), {edges}, ' ')"

    def let(self, value, var, to):
        return f"transform(array({value}), {var} -> {to(var)})[0]"

    def has(self, x, pattern):
        return f"regexp_like({x}, {self.lit(pattern)})"

    def size(self, x):
        return f"size({x})"

    def bytes(self, x):
        return f"octet_length({x})"

    def split(self, x, by):
        return f"split({x}, {self.lit(chr(92) + 'Q' + by + chr(92) + 'E')})"

    def keep(self, array, var, test):
        return f"filter({array}, {var} -> {test})"

    def each(self, array, var, to):
        return f"transform({array}, {var} -> {to})"

    def join(self, array, by):
        return f"array_join({array}, {self.lit(by)})"

    def slice(self, array, start, n):
        return f"slice({array}, {start}, {n})"

    def explode(self, source, keys, array, item="line"):
        return f"(SELECT {keys}, CAST(pos AS BIGINT) AS pos, {item} FROM {source} LATERAL VIEW posexplode({array}) x AS pos, {item})"

    def ordered(self, value, by, sep):
        return f"array_join(transform(filter(array_sort(collect_list(struct({by} AS o, {value} AS v))), e -> e.v IS NOT NULL), e -> e.v), {self.lit(sep)})"


class Duck(Dialect):
    name = "duck"

    def lit(self, s):
        return "'" + s.replace("'", "''") + "'"

    def sub(self, x, pattern, by=""):
        by = by.replace("\\", "\\\\").replace("$1", "\\1").replace("$2", "\\2")
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(by)}, 'g')"

    def has(self, x, pattern):
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def size(self, x):
        return f"len({x})"

    def bytes(self, x):
        return f"strlen({x})"

    def split(self, x, by):
        return f"string_split({x}, {self.lit(by)})"

    def keep(self, array, var, test):
        return f"list_filter({array}, lambda {var}: {test})"

    def each(self, array, var, to):
        return f"list_transform({array}, lambda {var}: {to})"

    def join(self, array, by):
        return f"array_to_string({array}, {self.lit(by)})"

    def slice(self, array, start, n):
        return f"({array})[{start}:{start + n - 1}]"

    def explode(self, source, keys, array, item="line"):
        return f"(SELECT {keys}, unnest(range(len(arr))) AS pos, unnest(arr) AS {item} FROM (SELECT *, {array} AS arr FROM {source}))"

    def ordered(self, value, by, sep):
        return f"coalesce(string_agg({value}, {self.lit(sep)} ORDER BY {by}), '')"


SPARK, DUCK = Spark(), Duck()
