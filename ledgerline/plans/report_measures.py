"""Report-layer measures whose own filters replace the reader's filter on the same column.

Grouping by ``is_active`` shows the same active count against both values, because the measure's
condition takes the place of the group's. Access roles restrict the tables themselves and so are
never replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.calendar import Period
from ledgerline.functions.numbers import RATIO
from ledgerline.operators.aggregate import Spec
from ledgerline.plans.metrics import MODELS, ModelFrame, SemanticModel, Where
from ledgerline.sources.tables import Tables


@dataclass(frozen=True)
class Term:
    agg: str
    expression: str
    replaces: Mapping[str, str] = field(default_factory=dict)  # dimension -> SQL condition


@dataclass(frozen=True)
class ReportMeasure:
    model: str
    terms: tuple[Term, ...]
    combine: str = "{0}"  # SQL over the terms


ACTIVE_BOOK = {"write_off_flag": "write_off_flag = false"}

MEASURES: dict[str, ReportMeasure] = {
    "Transaction Volume": ReportMeasure("transactions", (Term("sum", "abs(amount)"),)),
    "Net Fee Revenue": ReportMeasure(
        "transactions",
        (Term("sum", "-amount", {"transaction_type": "transaction_type = 'fee'", "fee_waived": "fee_waived = false"}),),
    ),
    "Active Customer Count": ReportMeasure(
        "customers", (Term("count_distinct", "customer_id", {"is_active": "is_active = true"}),)
    ),
    "Customer Inactivity Rate": ReportMeasure(
        "customers",
        (Term("count_distinct", "customer_id", {"is_active": "is_active = false"}), Term("count_distinct", "customer_id")),
        RATIO,
    ),
    "Average Daily Balance": ReportMeasure("account_balances", (Term("avg", "avg_daily_balance"),)),
    "Net Interest Income": ReportMeasure(
        "interest", (Term("sum", "interest_income"), Term("sum", "interest_expense")), "{0} - {1}"
    ),
    "Net Interest Margin": ReportMeasure(
        "interest",
        (Term("sum", "interest_income"), Term("sum", "interest_expense"), Term("sum", "outstanding_loan_balance")),
        RATIO.format("({0} - {1})", "{2}"),
    ),
    "Delinquency Rate 30D": ReportMeasure(
        "loans",
        (Term("count", "1", {"days_past_due": "days_past_due >= 30", **ACTIVE_BOOK}), Term("count", "1", ACTIVE_BOOK)),
        RATIO,
    ),
    "Delinquency Rate 90D": ReportMeasure(
        "loans",
        (Term("count", "1", {"days_past_due": "days_past_due >= 90", **ACTIVE_BOOK}), Term("count", "1", ACTIVE_BOOK)),
        RATIO,
    ),
    "Charge-off Rate": ReportMeasure(
        "loans", (Term("count", "1", {"write_off_flag": "write_off_flag = true"}), Term("count", "1")), RATIO
    ),
}


def evaluate(
    tables: Tables,
    measures: Sequence[str],
    by: Sequence[str] = (),
    where: Where | None = None,
    date_role: str | None = None,
    span: Period | None = None,
) -> DataFrame:
    """Measures of one table for every group the filters leave visible.

    The table is read once, down to the groups' finest keys: the reader's groups and whatever filtered column a
    measure replaces. Each term then adds up the fine rows that its own filters leave, over the groups it
    does not replace, so only these few rows are seen more than once.
    """
    where = where or {}
    models = {MEASURES[m].model for m in measures}
    if len(models) != 1:
        raise ValueError("measures of one table at a time")
    model = MODELS[models.pop()]
    terms = {f"{m}:{i}": t for m in measures for i, t in enumerate(MEASURES[m].terms)}
    replaced = {d for t in terms.values() for d in t.replaces}
    late = [d for d in where if d in replaced]  # filters that some term does without
    keys = list(dict.fromkeys([*by, *late]))
    frame = ModelFrame(tables, model, keys, {d: c for d, c in where.items() if d not in late}, date_role, span)
    specs = [Spec("_shown", "count", "1")]
    for name, term in terms.items():
        condition = " AND ".join(term.replaces.values()) or None
        if term.agg == "avg":
            specs.append(Spec(f"{name}:sum", "sum", f"CAST({term.expression} AS double)", condition))
            specs.append(Spec(f"{name}:n", "count", term.expression, condition))
        else:  # distinct counts are of the column that tells rows apart, so they add up too
            specs.append(Spec(name, "count" if _counts_rows(term, model) else term.agg, term.expression, condition))
    fine = frame.aggregate(specs)

    def kept(dimensions: Sequence[str]) -> Column:
        return reduce(and_, [where[d](F.col(d)) for d in late if d in dimensions], F.lit(True))

    def total(name: str, replaces: Sequence[str], count: bool) -> Column:
        over = [F.col(d) for d in by if d not in replaces]
        value = F.sum(F.when(kept([d for d in late if d not in replaces]), F.col(f"`{name}`")))
        value = value.over(Window.partitionBy(*over)) if by else value
        return F.coalesce(value, F.lit(0).cast("long")) if count else value

    values = [total("_shown", (), True).alias("_shown")]
    for name, term in terms.items():
        if term.agg == "avg":
            values.append((total(f"{name}:sum", term.replaces, False) / F.nullif(total(f"{name}:n", term.replaces, True), F.lit(0))).alias(name))
        else:
            values.append(total(name, term.replaces, term.agg.startswith("count")).alias(name))
    result = fine.select(*by, *values).distinct().where("_shown > 0") if by else fine.agg(*values)
    columns = [
        MEASURES[m].combine.format(*[f"`{m}:{i}`" for i in range(len(MEASURES[m].terms))]) + f" AS `{m}`" for m in measures
    ]
    return result.selectExpr(*by, *columns)


def _counts_rows(term: Term, model: SemanticModel) -> bool:
    if term.agg != "count_distinct":
        return False
    if model.grain != (term.expression,):
        raise ValueError(f"a distinct count of {term.expression} does not add up over groups")
    return True
