"""The findings of a comparison in SQL (DuckDB), for the equivalents of the registered queries; written from the rules, not from the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

from tidemark.operators.kpi import Metric
from tidemark.plans.findings import LAYERS, SEVERITIES
from tidemark.plans.lens import SCENARIOS

TIMES = 0.1


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rounded(x: str, places: int = 4) -> str:
    """By the exact decimal value, as Python rounds; round() goes by the product with a power of ten."""
    return f"CAST(printf('%.{places}f', CAST({x} AS DOUBLE)) AS DOUBLE)"


def spark_type(name: str) -> str:
    return f"CASE split_part({name}, '(', 1) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' ELSE lower({name}) END"


def p_value(d: str, m: str, n: str) -> str:
    """The asymptotic p-value, which holds for samples of more than 10,000 rows."""
    effective = f"round(CAST({m} AS DOUBLE) * {n} / ({m} + {n}))"
    return f"least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * {effective} * {d} * {d} * k * k)))))"


def _rule(m: Metric, before: str, after: str) -> str:
    change = f"abs({after} - {before}) / abs(nullif({before}, 0))"
    tests = ((m.fail_if_above, "FAIL", f"{after} >"), (m.warn_if_above, "WARN", f"{after} >"), (m.fail_if_below, "FAIL", f"{after} <"), (m.warn_if_below, "WARN", f"{after} <"), (m.fail_if_delta_pct, "FAIL", f"{change} >"), (m.warn_if_delta_pct, "WARN", f"{change} >"))
    given = [f"WHEN {test} {limit} THEN '{severity}'" for limit, severity, test in tests if limit is not None]
    return f"CASE {' '.join(given)} ELSE 'PASS' END" if given else "'INFO'"


def metric_severity(sides: str, metrics: list[tuple[Metric, str]]) -> str:
    each = [f"SELECT '{m.name}' AS name, (SELECT {sql} FROM b) AS x, (SELECT {sql} FROM a) AS y" for m, sql in metrics]
    graded = " UNION ALL ".join(f"SELECT name, round(x, 6) AS value_before, round(y, 6) AS value_after, {_rule(m, 'x', 'y')} AS severity FROM v WHERE name = '{m.name}'" for m, _ in metrics)
    return f"{sides}, v AS ({' UNION ALL '.join(each)}) {graded}"


def _cells(numbers: dict[str, str], texts: dict[str, str] | None = None) -> str:
    cell = lambda k, n, t: f"{{'key': '{k}', 'number': CAST({n} AS DOUBLE), 'text': CAST({t} AS VARCHAR)}}"
    return "[" + ", ".join([cell(k, v, "NULL") for k, v in numbers.items()] + [cell(k, "NULL", v) for k, v in (texts or {}).items()]) + "]"


@dataclass(frozen=True)
class Pair:
    """Two versions of a table (queries), the classes of the columns that both have, the key, and declared metrics with their SQL."""

    before: str
    after: str
    columns: dict[str, str]
    key: str | None = None
    metrics: list[tuple[Metric, str]] = field(default_factory=list)

    def schema(self) -> str:
        """ord, layer, col, severity, title, cells."""
        kinds = f"SELECT coalesce(b.column_name, a.column_name) AS col, {spark_type('b.column_type')} AS kb, {spark_type('a.column_type')} AS ka FROM (DESCRIBE {self.before}) b FULL JOIN (DESCRIBE {self.after}) a ON b.column_name = a.column_name"
        known = f"SELECT * FROM ({kinds}) WHERE kb IS DISTINCT FROM ka"
        cells = f"CASE WHEN kb IS NULL THEN {_cells({}, {'column': 'col', 'dtype': 'ka'})} WHEN ka IS NULL THEN {_cells({}, {'column': 'col', 'dtype': 'kb'})} ELSE {_cells({}, {'column': 'col', 'before': 'kb', 'after': 'ka'})} END"
        title = "CASE WHEN kb IS NULL THEN format('Column added: ''{}'' (type: {})', col, ka) WHEN ka IS NULL THEN format('Column removed: ''{}'' (was: {})', col, kb) ELSE format('Type changed: ''{}'' ({} → {})', col, kb, ka) END"
        places = " ".join(f"WHEN col = {quoted(c)} THEN {k}" for k, c in enumerate(self.columns))
        place = f"CASE {places} WHEN ka IS NULL THEN 900 ELSE 901 END"
        return f"SELECT CAST({place} AS DOUBLE) AS ord, 'schema' AS layer, col, CASE WHEN ka IS NULL THEN 'FAIL' ELSE 'WARN' END AS severity, {title} AS title, {cells} AS cells FROM ({known})"

    def _numeric(self, c: str, at: int) -> list[str]:
        x = f"CAST({c} AS DOUBLE)"
        measures = {"n": f"count({c})", "mean": f"avg({x})", "median": f"quantile_cont({x}, 0.5)", "std": f"stddev_samp({x})", "p25": f"quantile_cont({x}, 0.25)", "p75": f"quantile_cont({x}, 0.75)"}
        sides = ", ".join(f"(SELECT {sql} FROM {t}) AS {k}_{side}" for k, sql in measures.items() for t, side in (("b", "before"), ("a", "after")))
        delta = "(mean_after - mean_before) / abs(mean_before)"
        numbers = {f"{k}_{side}": rounded(f"{k}_{side}") for k in measures if k != "n" for side in ("before", "after")} | {"delta_pct": rounded(f"{delta}")}
        mean = f"SELECT {at + 1} AS ord, 'distribution' AS layer, '{c}' AS col, CASE WHEN abs({delta}) > {2 * TIMES} THEN 'FAIL' ELSE 'WARN' END AS severity, {_cells(numbers)} AS cells FROM (SELECT {sides}) WHERE least(n_before, n_after) >= 5 AND mean_before <> 0 AND abs({delta}) > {TIMES}"
        values = f"SELECT v, sum(x) AS nb, sum(y) AS na FROM (SELECT {x} AS v, 1 AS x, 0 AS y FROM b UNION ALL SELECT {x}, 0, 1 FROM a) WHERE v IS NOT NULL GROUP BY v"
        running = f"SELECT sum(nb) OVER w AS cb, sum(na) OVER w AS ca, sum(nb) OVER () AS tb, sum(na) OVER () AS ta FROM ({values}) WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        d = f"SELECT max(abs(CAST(cb AS DOUBLE) / tb - CAST(ca AS DOUBLE) / ta)) AS d, max(tb) AS m, max(ta) AS n FROM ({running})"
        p = p_value("d", "m", "n")
        shape = f"SELECT {at + 2}, 'distribution', '{c}', 'WARN', {_cells({'ks_statistic': rounded('d'), 'p_value': rounded(f'{p}')})} FROM ({d}) WHERE least(m, n) >= 5 AND d > 0.1 AND {p} < 0.05"
        return [mean, shape]

    def _category(self, c: str, at: int) -> list[str]:
        counts = f"SELECT v, sum(x) AS nb, sum(y) AS na FROM (SELECT {c} AS v, 1 AS x, 0 AS y FROM b UNION ALL SELECT {c}, 0, 1 FROM a) WHERE v IS NOT NULL GROUP BY v"
        sums = f"SELECT count(*) FILTER (nb = 0) AS fresh, count(*) FILTER (na = 0) AS gone, count(*) FILTER (nb > 0) AS known FROM ({counts})"
        shares = f"SELECT v, nb, na, CAST(nb AS DOUBLE) / sum(nb) OVER () AS sb, CAST(na AS DOUBLE) / sum(na) OVER () AS sa, row_number() OVER (ORDER BY v) / 10000.0 AS place FROM ({counts})"
        return [
            f"SELECT {at + 3} AS ord, 'distribution' AS layer, '{c}' AS col, 'INFO' AS severity, {_cells({'new_values': 'least(fresh, 1000)', 'new_count': 'fresh'})} AS cells FROM ({sums}) WHERE fresh > 0",
            f"SELECT {at + 4}, 'distribution', '{c}', CASE WHEN CAST(gone AS DOUBLE) / greatest(known, 1) > 0.5 THEN 'FAIL' ELSE 'WARN' END, {_cells({'missing_values': 'least(gone, 1000)', 'missing_count': 'gone'})} FROM ({sums}) WHERE gone > 0",
            f"SELECT {at + 5} + place, 'distribution', '{c}', 'WARN', {_cells({'before': rounded('sb'), 'after': rounded('sa'), 'delta': rounded('sa - sb')}, {'value': 'v'})} FROM ({shares}) WHERE nb > 0 AND na > 0 AND abs(sa - sb) > {TIMES}",
        ]

    def _dates(self, c: str, at: int) -> list[str]:
        bounds = ", ".join(f"(SELECT {f}({c}) FROM {x}) AS {f}_{side}" for x, side in (("b", "before"), ("a", "after")) for f in ("min", "max"))
        texts = {f"{f}_{side}": f"CAST(CAST({f}_{side} AS DATE) AS VARCHAR)" for side in ("before", "after") for f in ("min", "max")}
        return [f"SELECT {at + 8} AS ord, 'distribution' AS layer, '{c}' AS col, 'INFO' AS severity, {_cells({'instants': '4'}, texts)} AS cells FROM (SELECT {bounds}) WHERE min_before <> min_after OR max_before <> max_after"]

    def _nulls(self, c: str, at: int) -> str:
        rate = lambda x: f"(SELECT avg(CAST({c} IS NULL AS DOUBLE)) FROM {x})"
        numbers = {"null_before": rounded("x"), "null_after": rounded("y"), "delta": rounded("y - x")}
        return f"SELECT {at} AS ord, 'distribution' AS layer, '{c}' AS col, CASE WHEN abs(y - x) > {2 * TIMES} THEN 'FAIL' ELSE 'WARN' END AS severity, {_cells(numbers)} AS cells FROM (SELECT {rate('b')} AS x, {rate('a')} AS y) WHERE abs(y - x) > {TIMES}"

    def _keys(self) -> list[str]:
        k = f"SELECT k, sum(x) AS nb, sum(y) AS na FROM (SELECT {self.key} AS k, 1 AS x, 0 AS y FROM b UNION ALL SELECT {self.key}, 0, 1 FROM a) GROUP BY k"
        n = f"SELECT sum(greatest(na - 1, 0)) AS dup, count(*) FILTER (na > 1) AS dup_keys, count(*) FILTER (na = 0 AND k IS NOT NULL) AS del, count(*) FILTER (nb = 0 AND k IS NOT NULL) AS fresh, count(*) FILTER (nb > 0 AND k IS NOT NULL) AS known FROM ({k})"
        share = "CAST(del AS DOUBLE) / greatest(known, 1)"
        row = lambda ord_, severity, numbers, test: f"SELECT {ord_} AS ord, 'integrity' AS layer, '{self.key}' AS col, {severity} AS severity, {_cells(numbers)} AS cells FROM ({n}) WHERE {test} > 0"
        return [
            row(1_000_000, "'FAIL'", {"duplicate_count": "dup", "sample": "least(5, dup_keys)"}, "dup"),
            row(1_000_001, f"CASE WHEN {share} > 0.1 THEN 'FAIL' ELSE 'WARN' END", {"deleted_count": "del", "delete_pct": rounded(f"{share}"), "sample": "least(5, del)"}, "del"),
            row(1_000_002, "'INFO'", {"added_count": "fresh", "sample": "least(5, fresh)"}, "fresh"),
        ]

    def _declared(self, m: Metric, sql: str, at: int) -> str:
        column = quoted(m.column) if m.column else "CAST(NULL AS VARCHAR)"
        numbers = {"value_before": rounded("x", 6), "value_after": rounded("y", 6), "delta_pct": rounded("(y - x) / abs(nullif(x, 0))")}
        return f"SELECT {2_000_000 + at} AS ord, 'custom' AS layer, {column} AS col, {_rule(m, 'x', 'y')} AS severity, {_cells(numbers, {'name': quoted(m.name), 'type': quoted(m.type)})} AS cells FROM (SELECT (SELECT {sql} FROM b) AS x, (SELECT {sql} FROM a) AS y)"

    def findings(self, scenario: str = "general") -> str:
        """CTEs, of which the last, r, has a row a finding: seq, layer, col, severity, cells."""
        parts = [f"SELECT ord, layer, col, severity, cells FROM ({self.schema()})"]
        checks = {"numeric": self._numeric, "category": self._category, "datetime": self._dates}
        for k, (c, kind) in enumerate(self.columns.items(), 1):
            parts.append(self._nulls(c, 1000 * k))
            parts += checks[kind](c, 1000 * k) if kind in checks else []
        parts += self._keys() if self.key else []
        parts += [self._declared(m, sql, k) for k, (m, sql) in enumerate(self.metrics)]
        _, up, down = SCENARIOS[scenario]
        step = " ".join([f"WHEN layer = '{x}' THEN 1" for x in up] + [f"WHEN layer = '{x}' THEN -1" for x in down if x not in up])
        rank = lambda column, names: "CASE " + " ".join(f"WHEN {column} = '{x}' THEN {k}" for k, x in enumerate(names)) + " END"
        return (
            f"WITH b AS ({self.before}), a AS ({self.after}), f AS ({' UNION ALL '.join(parts)}), "
            f"g AS (SELECT *, least(3, greatest(0, {rank('severity', SEVERITIES)} + {f'CASE {step} ELSE 0 END' if step else '0'})) AS s FROM f), "
            f"r AS (SELECT CAST(row_number() OVER (ORDER BY s DESC, {rank('layer', LAYERS)}, ord) - 1 AS INTEGER) AS seq, layer, col, {list(SEVERITIES)}[s + 1] AS severity, cells FROM g)"
        )

    def measures(self, scenario: str = "general") -> str:
        cells = "SELECT seq, layer, col, severity, unnest(cells) AS x FROM r"
        return f"{self.findings(scenario)} SELECT seq, layer, col AS \"column\", severity, x.key AS key, x.number AS number, x.text AS text FROM ({cells}) WHERE x.number IS NOT NULL OR x.text IS NOT NULL"

    def severities(self, scenario: str) -> str:
        return f"{self.findings(scenario)} SELECT seq, layer, col AS \"column\", severity FROM r"

    def counts(self, scenario: str) -> str:
        return f"{self.findings(scenario)} SELECT layer, severity, count(*) AS n FROM r GROUP BY ALL"
