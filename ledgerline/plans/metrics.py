"""Named metrics over the marts, sliced by dimension and time grain.

Every metric of one semantic model is a conditional aggregate over a single pass of its mart.
Ratios and derived metrics are arithmetic on those aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.calendar import GRAINS, Period, period_start_sql, within
from ledgerline.functions.numbers import RATIO
from ledgerline.operators.aggregate import Spec, aggregate, stack_groups
from ledgerline.operators.joins import latest_sql, lookup
from ledgerline.plans.entities import Route, attributes, route
from ledgerline.sources.tables import Tables

Where = Mapping[str, Callable[[Column], Column]]

PERIOD = "period"


@dataclass(frozen=True)
class SemanticModel:
    mart: str
    grain: tuple[str, ...]                 # columns one row is unique on
    time: str | None                       # default time column
    base_grain: str                        # finest grain of that column
    entities: Mapping[str, str]            # entity -> key column
    dimensions: Mapping[str, str]          # dimension -> SQL expression
    measures: Mapping[str, tuple[str, str]]  # measure -> (aggregate, SQL expression)
    other_times: tuple[str, ...] = ()      # times used only on request
    # entity -> attribute -> SQL aggregate that makes one of an entity's several rows; without it other models cannot use them
    per_key: Mapping[str, Mapping[str, str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Metric:
    kind: str                              # simple | ratio | derived
    label: str                             # what a reader sees, see ``labels``
    model: str = ""
    measure: str = ""
    where: str | None = None               # SQL condition ANDed with the query's own filters
    parts: tuple[str, ...] = ()            # metrics a ratio or derived metric is made of
    combine: str = ""                      # SQL over the parts, {0} {1} ...


# the days past due of the last month, in the stages of delinquency
_LAST = latest_sql("month_start", "days_past_due")
LOAN_STATUS = f"CASE WHEN {_LAST} >= 90 THEN '90+' WHEN {_LAST} >= 30 THEN '30-89' WHEN {_LAST} >= 0 THEN 'current' END"


# Entities, dimensions and measure expressions as the semantic models declare them.
MODELS: dict[str, SemanticModel] = {
    "transactions": SemanticModel(
        mart="fct_transactions",
        grain=("transaction_id",),
        time="transaction_date",
        base_grain="day",
        other_times=("posting_date",),
        entities={"transaction": "transaction_id", "account": "account_id", "customer": "customer_id"},
        dimensions={
            "transaction_type": "transaction_type",
            "fee_waived": "fee_waived",
            "transaction_branch_name": "transaction_branch_name",
            "transaction_region": "transaction_region",
            "home_branch_name": "home_branch_name",
            "home_region": "home_region",
        },
        measures={
            "transaction_amount_abs": ("sum", "abs(amount)"),
            "fee_amount": ("sum", "case when transaction_type = 'fee' then -amount else 0 end"),
            "transaction_rows": ("count", "1"),
        },
    ),
    "customers": SemanticModel(
        mart="dim_customers",
        grain=("customer_id",),
        time="signup_date",
        base_grain="day",
        entities={"customer": "customer_id"},
        dimensions={"region": "region", "home_branch_name": "home_branch_name", "is_active": "is_active"},
        measures={"customer_count": ("count_distinct", "customer_id")},
    ),
    "account_balances": SemanticModel(
        mart="fct_account_balances_monthly",
        grain=("account_id", "month_start"),
        time="month_start",
        base_grain="month",
        entities={"account": "account_id", "customer": "customer_id"},
        dimensions={"product_id": "product_id"},
        measures={
            "avg_daily_balance_measure": ("avg", "avg_daily_balance"),
            "month_end_balance_measure": ("avg", "month_end_balance"),
        },
        per_key={
            "account": {
                "product_id": "max(product_id)",
                "customer_id": "max(customer_id)",
                "largest_month_end_balance": "max(month_end_balance)",
            },
        },
    ),
    "interest": SemanticModel(
        mart="fct_interest_monthly",
        grain=("account_id", "month_start"),
        time="month_start",
        base_grain="month",
        entities={"account": "account_id", "customer": "customer_id"},
        dimensions={"product_id": "product_id"},
        measures={
            "interest_income_measure": ("sum", "interest_income"),
            "interest_expense_measure": ("sum", "interest_expense"),
            "outstanding_loan_balance_measure": ("sum", "outstanding_loan_balance"),
        },
        per_key={"account": {"product_id": "max(product_id)", "customer_id": "max(customer_id)"}},
    ),
    "loans": SemanticModel(
        mart="fct_loans_monthly",
        grain=("loan_account_id", "month_start"),
        time="month_start",
        base_grain="month",
        entities={"loan": "loan_account_id", "customer": "customer_id"},
        dimensions={
            "write_off_flag": "write_off_flag",
            "days_past_due": "days_past_due",
            "product_id": "product_id",
        },
        measures={
            "loan_count": ("count_distinct", "loan_account_id"),
            "delinquent_30d_indicator": ("sum", "case when days_past_due >= 30 then 1 else 0 end"),
            "delinquent_90d_indicator": ("sum", "case when days_past_due >= 90 then 1 else 0 end"),
            "write_off_indicator": ("sum", "case when write_off_flag then 1 else 0 end"),
            "loan_months": ("count", "1"),
        },
        per_key={
            # a customer's loans in their last month: the worst of them
            "customer": {"loan_status": LOAN_STATUS, "has_written_off_loan": "bool_or(write_off_flag)", "loans": "count(DISTINCT loan_account_id)"},
            "loan": {"product_id": "max(product_id)", "customer_id": "max(customer_id)", "loan_status": LOAN_STATUS},
        },
    ),
}


def _simple(label: str, model: str, measure: str, where: str | None = None) -> Metric:
    return Metric("simple", label, model, measure, where)


def _ratio(label: str, numerator: str, denominator: str) -> Metric:
    return Metric("ratio", label, parts=(numerator, denominator), combine=RATIO)


METRICS: dict[str, Metric] = {
    "transaction_volume": _simple("Transaction Volume", "transactions", "transaction_amount_abs"),
    "fee_revenue_net": _simple("Fee Revenue (Net)", "transactions", "fee_amount", "fee_waived = false"),
    "fee_revenue_gross": _simple("Fee Revenue (Gross)", "transactions", "fee_amount"),
    "transaction_count": _simple("Transaction Count", "transactions", "transaction_rows"),
    "customer_count": _simple("Customer Count", "customers", "customer_count"),
    "active_customer_count": _simple("Active Customer Count", "customers", "customer_count", "is_active = true"),
    "inactive_customer_count": _simple("Inactive Customer Count", "customers", "customer_count", "is_active = false"),
    "customer_inactivity_rate": _ratio("Customer Inactivity Rate", "inactive_customer_count", "customer_count"),
    "average_daily_balance": _simple("Average Daily Balance", "account_balances", "avg_daily_balance_measure"),
    "month_end_balance": _simple("Month-End Balance", "account_balances", "month_end_balance_measure"),
    "gross_interest_income": _simple("Gross Interest Income", "interest", "interest_income_measure"),
    "gross_interest_expense": _simple("Gross Interest Expense", "interest", "interest_expense_measure"),
    "net_interest_income": Metric(
        "derived",
        "Net Interest Income",
        parts=("gross_interest_income", "gross_interest_expense"),
        combine="({0} - {1})",
    ),
    "total_outstanding_loan_balance": _simple(
        "Total Outstanding Loan Balance", "interest", "outstanding_loan_balance_measure"
    ),
    "net_interest_margin": _ratio("Net Interest Margin", "net_interest_income", "total_outstanding_loan_balance"),
    "active_loan_count": _simple("Active Loan Count", "loans", "loan_count", "write_off_flag = false"),
    "total_loan_count": _simple("Total Loan Count", "loans", "loan_count"),
    "delinquent_30d_count": _simple("30+ DPD Count, Active Book", "loans", "delinquent_30d_indicator", "write_off_flag = false"),
    "delinquency_rate_30d": _ratio("Delinquency Rate (30d)", "delinquent_30d_count", "active_loan_count"),
    "delinquent_90d_count": _simple("90+ DPD Count, Active Book", "loans", "delinquent_90d_indicator", "write_off_flag = false"),
    "delinquency_rate_90d": _ratio("Delinquency Rate (90d)", "delinquent_90d_count", "active_loan_count"),
    "charge_off_count": _simple("Charge-Off Count", "loans", "write_off_indicator"),
    "charge_off_rate": _ratio("Charge-Off Rate", "charge_off_count", "total_loan_count"),
    # the other reading of the loan rates: loan-months over loan-months
    "active_loan_months": _simple("Active Loan-Months", "loans", "loan_months", "write_off_flag = false"),
    "total_loan_months": _simple("Loan-Months", "loans", "loan_months"),
    "delinquency_rate_30d_by_month_rows": _ratio("Delinquency Rate 30D (rows)", "delinquent_30d_count", "active_loan_months"),
    "delinquency_rate_90d_by_month_rows": _ratio("Delinquency Rate 90D (rows)", "delinquent_90d_count", "active_loan_months"),
    "charge_off_rate_by_month_rows": _ratio("Charge-off Rate (rows)", "charge_off_count", "total_loan_months"),
}


def labels(names: Sequence[str] | None = None) -> dict[str, str]:
    """The names readers see, by metric."""
    return {name: METRICS[name].label for name in names or METRICS}


def simple_parts(name: str) -> list[str]:
    """The simple metrics a metric rests on, through any depth of ratios and derivations."""
    metric = METRICS[name]
    if metric.kind == "simple":
        return [name]
    return [leaf for part in metric.parts for leaf in simple_parts(part)]


def _value(name: str) -> str:
    metric = METRICS[name]
    if metric.kind == "simple":
        return f"`{name}`"
    return metric.combine.format(*[_value(part) for part in metric.parts])


def _spec(name: str) -> Spec:
    metric = METRICS[name]
    agg, value = MODELS[metric.model].measures[metric.measure]
    return Spec(name, agg, value, metric.where, "0" if agg == "sum" else "")


class ModelFrame:
    """A mart with the requested dimensions resolved: its own, the customer's and the calendar's."""

    def __init__(
        self,
        tables: Tables,
        model: SemanticModel,
        by: Sequence[str],
        where: Where,
        time: str | None,
        span: Period | None = None,
    ):
        self.tables, self.model = tables, model
        self.time = time or model.time
        if self.time not in (model.time, *model.other_times):
            raise ValueError(f"{model.mart} has no time {self.time!r}")
        self.frame = within(tables.ref(model.mart), span, self.time)
        wanted = list(dict.fromkeys([*by, *where]))
        self.calendar = [d.removeprefix("date__") for d in wanted if d.startswith("date__")]
        own = [d for d in wanted if d in model.dimensions or d.startswith("date__")]
        # dimensions of other models, together where they come the same way
        self.foreign: dict[tuple, dict[str, Route]] = {}
        for d in wanted:
            if d not in own:
                way = route(MODELS, model, d)
                self.foreign.setdefault(way.steps, {})[d] = way
        if self.calendar:
            days = tables.ref("dim_dates").select(
                F.col("date_key").alias(self.time), *[F.col(c).alias(f"date__{c}") for c in self.calendar]
            )
            chosen = days
            for d in self.calendar:
                if f"date__{d}" in where:
                    chosen = chosen.where(where[f"date__{d}"](F.col(f"date__{d}")))
            if any(f"date__{d}" in where for d in self.calendar):
                # the days that can match span a range, and a range reaches the files
                first, last = (chosen.agg(f(self.time).alias("day")).scalar() for f in (F.min, F.max))
                self.frame = self.frame.where((F.col(self.time) >= first) & (F.col(self.time) <= last))
            self.frame = self.frame.join(days, self.time, "left")
        for d, condition in where.items():
            if d in own:
                self.frame = self.frame.where(condition(F.expr(self.dimension(d))))
        self.own_by = {d: self.dimension(d) for d in by if d in own}
        self.foreign_by = [d for d in by if d not in own]
        self.where = where

    def dimension(self, name: str) -> str:
        return name if name.startswith("date__") else self.model.dimensions[name]

    def aggregate(self, specs: Sequence[Spec], grain: str | None = None) -> DataFrame:
        by = dict(self.own_by)
        if grain:
            if GRAINS.index(grain) < GRAINS.index(self.model.base_grain):
                raise ValueError(f"{self.model.mart} is kept by {self.model.base_grain}, not by {grain}")
            by[PERIOD] = period_start_sql(grain, self.time)
        frame = self.frame
        for steps, dimensions in self.foreign.items():
            told = attributes(self.tables, MODELS, self.model, dimensions)
            conditions = [self.where[d](F.col(d)) for d in dimensions if d in self.where]
            for condition in conditions:
                told = told.where(condition)
            frame = lookup(frame, told, self.model.entities[steps[0][0]], "inner" if conditions else "left")
        return aggregate(frame, {**by, **{d: f"`{d}`" for d in self.foreign_by}}, specs, self.model.grain)


def query(
    tables: Tables,
    metrics: Sequence[str],
    by: Sequence[str] = (),
    grain: str | None = None,
    where: Where | None = None,
    time: str | None = None,
    span: Period | None = None,
    spine: bool = False,
    fill: bool = False,
) -> DataFrame:
    """Metrics by dimensions and, with a grain, by period of the model's time column.

    ``by`` and ``where`` name the mart's own dimensions, attributes of an entity such as ``customer__region`` or
    ``account__interest__product_id``, which the shortest route over entities leads to (see ``entities``), or ``date__*`` attributes of the calendar. ``time`` picks another date role such
    as ``posting_date``; ``span`` keeps one period of it, as a range the files are pruned by. With ``spine`` every group has every period of
    the calendar (of the span), and periods outside of it go; with ``fill`` a period in which a group has no rows holds what each metric's
    rule says, see ``fill_rule``, and NULL otherwise.
    """
    leaves = list(dict.fromkeys(leaf for m in metrics for leaf in simple_parts(m)))
    groups = [*by, *([PERIOD] if grain else [])]
    if fill and not spine:
        raise ValueError("only a spine has periods to fill")
    frames = []
    for name, model in MODELS.items():
        own = [leaf for leaf in leaves if METRICS[leaf].model == name]
        if own:
            frame = ModelFrame(tables, model, by, where or {}, time, span)
            frames.append(frame.aggregate([_spec(leaf) for leaf in own], grain))
    result = stack_groups(frames, groups, leaves)
    if spine:
        if not grain:
            raise ValueError("a spine needs a grain")
        result = on_spine(result, by, leaves, grain, within(tables.ref("dim_dates"), span, "date_key"))
    if fill:
        zeros = {leaf: F.lit(0).cast(result.schema[leaf].dataType) for leaf in leaves if fill_rule(leaf) == 0}
        result = result.withColumns({leaf: F.coalesce(F.col(leaf), zero) for leaf, zero in zeros.items()})
    return result.selectExpr(*groups, *[f"{_value(m)} AS `{m}`" for m in metrics])


def fill_rule(name: str) -> int | None:
    """What a simple metric is over no rows: sums and counts are 0, an average is not known. A ratio or derived metric follows from
    its parts, so a ratio over nothing is NULL and a difference of sums 0."""
    metric = METRICS[name]
    return None if MODELS[metric.model].measures[metric.measure][0] == "avg" else 0


SPINE_STEPS = {"day": "1 day", "month": "1 month", "quarter": "3 month", "year": "12 month"}


def on_spine(result: DataFrame, by: Sequence[str], values: Sequence[str], grain: str, days: DataFrame) -> DataFrame:
    """Every group of a result with every period from the first to the last of ``days``.

    A group's periods are one ``sequence`` taken apart, and a group-by brings result and periods together: no cross join, and groups of NULL
    stay one group. Both sides read the result from the same shuffle.
    """
    calendar = [d for d in by if d.startswith("date__")]
    if calendar:
        raise ValueError(f"{calendar[0]} follows from the period; a spine cannot hold it against other periods")
    first, last = (days.agg(f("date_key").alias("day")).selectExpr(f"{period_start_sql(grain, 'day')} AS day").scalar() for f in (F.min, F.max))
    inside = result.where(F.col(PERIOD).between(first, last))
    groups = inside.select(*by).distinct() if by else result.sparkSession.range(0, 1, 1, 1).select()
    step = F.expr(f"interval {SPINE_STEPS[grain]}")
    every = groups.select(*by, F.explode(F.sequence(first, last, step)).alias(PERIOD))
    return stack_groups([inside, every], [*by, PERIOD], values)


def compare_periods(series: DataFrame, value: str, by: Sequence[str] = (), months: int = 3) -> DataFrame:
    """Each period next to the one ``months`` earlier, with the change.

    A period is also emitted under its successor's date and the two meet in a group-by, so no window
    runs over the whole series and missing periods are not skipped over. A period with nothing of its own stays, up to
    the last of the series: it fell by all that was before.
    """
    kind = series.schema[value].dataType.simpleString()
    shifted = f"""inline(array(
        named_struct('{PERIOD}', {PERIOD}, 'current', `{value}`, 'previous', CAST(NULL AS {kind})),
        named_struct('{PERIOD}', add_months({PERIOD}, {months}), 'current', CAST(NULL AS {kind}), 'previous', `{value}`)))"""
    return (
        series.selectExpr(*by, shifted)
        .groupBy(*by, PERIOD)
        .agg(F.max("current").alias("current"), F.max("previous").alias("previous"))
        .where(F.col("current").isNotNull() | (F.col(PERIOD) <= series.agg(F.max(PERIOD)).scalar()))
        .selectExpr("*", "if(previous IS NULL, NULL, coalesce(current, 0) - previous) AS delta")
    )


# columns that may be totalled without naming a metric; averages, keys and calendar parts may not
ADDITIVE = {
    "fct_transactions": ("amount",),
    "fct_interest_monthly": ("interest_income", "interest_expense"),
    "fct_account_balances_monthly": (),
}
# balances at a point in time: they add up across accounts, never across months
SNAPSHOTS = {
    "fct_interest_monthly": ("outstanding_loan_balance",),
    "fct_account_balances_monthly": ("month_end_balance",),
}


# a date and a balance in one long: days above, hundredths with room for the sign below
_SLOT = 2**42


def last_balance_sql(day: str, balance: str) -> str:
    """The balance of the last day that has one, as a SQL aggregate: a plain ``max`` over a long, combined in the tasks."""
    code = f"max(unix_date({day}) * {_SLOT}L + CAST({balance} * 100 AS bigint) + {_SLOT // 2}L)"
    return f"CAST((pmod({code}, {_SLOT}L) - {_SLOT // 2}L) / CAST(100 AS decimal(3,0)) AS decimal(14,2))"


def implicit_totals(
    tables: Tables, mart: str, by: Sequence[str] = (), columns: Sequence[str] | None = None, grain: str | None = None
) -> DataFrame:
    """Totals of a mart's columns; by default all that may be totalled in these groups.

    With ``grain`` also by period of the mart's months. A balance is then that of the last month of the period in which an account has
    one, added up over accounts; what accrues is added up over months too.
    """
    snapshots = SNAPSHOTS.get(mart, ())
    by_month = "month_start" in by
    wanted = columns if columns is not None else [*ADDITIVE[mart], *(snapshots if by_month or grain else ())]
    for c in wanted:
        if c in snapshots and not by_month and not grain:
            raise ValueError(f"{c} is a balance at the end of a month; total it by month_start or by a grain")
        if c not in (*ADDITIVE[mart], *snapshots):
            raise ValueError(f"{c} of {mart} cannot be totalled")
    if not wanted:
        raise ValueError(f"{mart} has nothing to total but balances; total them by month_start or by a grain")
    if grain is None:
        return tables.ref(mart).groupBy(*by).agg(*[F.sum(c).alias(c) for c in wanted])
    model = next(m for m in MODELS.values() if m.mart == mart)
    if GRAINS.index(grain) < GRAINS.index(model.base_grain):
        raise ValueError(f"{mart} is kept by {model.base_grain}, not by {grain}")
    period = F.expr(f"{period_start_sql(grain, model.time)} AS {PERIOD}")
    if not any(c in snapshots for c in wanted):
        return tables.ref(mart).groupBy(*by, period).agg(*[F.sum(c).alias(c) for c in wanted])
    parts = {c: last_balance_sql(model.time, c) if c in snapshots else f"sum({c})" for c in wanted}
    per_account = tables.ref(mart).groupBy(*by, model.entities["account"], period).agg(*[F.expr(f"{sql} AS {c}") for c, sql in parts.items()])
    return per_account.groupBy(*by, PERIOD).agg(*[F.sum(c).alias(c) for c in wanted])


def dimension_values(tables: Tables, mart: str, column: str) -> DataFrame:
    return tables.ref(mart).select(column).distinct()
