"""Consistency rules of a page: conditions over its fields that add flags, or make blanks not applicable.

The fields of a page, at most a few hundred, are gathered in one group; every rule is an expression over
the gathered list, so all rules of all pages take one shuffle and no join back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import BP_RULE

# Visit columns in the order of the form, and rows of a previous delivery.
VISITS = ["t1v1", "t1v2", "t1v3", "t2v1", "t2v2", "t2v3", "m7", "m8", "m9"]
PREVIOUS = ["date", "mode", "cs_indication", "complication", "weight", "nb_complication"]


@dataclass
class Page:
    """The rules of one page type. Accessors name a column that holds what a field says, null if it says nothing."""

    columns: dict[str, str]
    flags: list[tuple[str, list[str], str]] = field(default_factory=list)
    blanks: list[tuple[str, list[str], str]] = field(default_factory=list)

    def _column(self, expression: str) -> str:
        return self.columns.setdefault(expression, f"__a{len(self.columns)}")

    def value(self, name: str) -> str:
        return self._column(f"get(filter(__rows, r -> r.id = '{name}'), 0)") + ".said"

    def date(self, name: str) -> str:
        return f"try_to_date({self.value(name)}, 'yyyy-MM-dd')"

    def number(self, name: str) -> str:
        return f"if({self.value(name)} rlike '^-?[0-9]+([.][0-9]+)?$', try_cast({self.value(name)} as double), null)"

    def ticked(self, name: str) -> str:
        return self._column(f"get(filter(__rows, r -> r.id = '{name}'), 0)") + ".ticked"

    def flag(self, when: str, names: list[str], flag: str) -> None:
        self.flags.append((when, names, flag))

    def blank(self, when: str, names: list[str], reason: str) -> None:
        self.blanks.append((when, names, reason))

    def pressure(self, name: str) -> None:
        low, high, least, most = BP_RULE
        upper, lower = (f"try_cast(regexp_extract({self.value(name)}, '^([0-9]{{2,3}})/([0-9]{{2,3}})$', {k}) as int)" for k in (1, 2))
        self.flag(f"not ({upper} between {low} and {high} and {lower} between {least} and {most} and {upper} > {lower})", [name], "bp_implausible")


def _pregnancy(page: Page) -> None:
    lmp, edd, late = ((f"pregnancy.{x}", page.date(f"pregnancy.{x}")) for x in ("lmp_date", "edd", "term_exceeded_date"))
    page.flag(f"abs(datediff({edd[1]}, {lmp[1]}) - 280) > 4", [lmp[0], edd[0]], "edd_inconsistent_with_lmp")
    page.flag(f"datediff({late[1]}, {edd[1]}) not between 5 and 15", [edd[0], late[0]], "post_term_inconsistent_with_edd")
    names = {row: [f"pregnancy.visit.{v}.{row}" for v in VISITS] for row in ("visit_date", "gest_age", "appointment", "weight", "bp")}
    days, weights = [page.date(x) for x in names["visit_date"]], [page.number(x) for x in names["weight"]]
    for k, day in enumerate(days):
        own = names["visit_date"][k]
        page.flag(f"abs(datediff({day}, {lmp[1]}) / 7 - {page.number(names['gest_age'][k])}) > 2.5", [names["gest_age"][k], own], "gest_age_inconsistent_with_dates")
        page.flag(f"abs(datediff({page.date(names['appointment'][k])}, {day})) > 120", [names["appointment"][k], own], "appointment_far_from_visit")
        page.flag(f"datediff({day}, {lmp[1]}) not between 0 and 320", [own], "visit_date_outside_pregnancy")
        page.pressure(names["bp"][k])
        if k:
            last = f"coalesce({', '.join([*weights[:k][::-1], 'null'])})"
            page.flag(f"abs({weights[k]} - {last}) > 6", [names["weight"][k]], "weight_jump_between_visits")
        for j in range(k):  # the last visit with a date before this one
            between = "".join(f" and {x} is null" for x in days[j + 1 : k])
            page.flag(f"{day} < {days[j]}{between}", [own, names["visit_date"][j]], "visits_out_of_order")


def _history(page: Page) -> None:
    of = lambda x: f"history.{x}"
    g, p, living, lost = (page.number(of(x)) for x in ("gravidity", "parity", "living_children", "anomaly.abortion.count"))
    page.flag(f"{p} > {g}", [of("gravidity"), of("parity")], "parity_exceeds_gravidity")
    page.flag(f"{living} > {p} + 2", [of("parity"), of("living_children")], "living_children_exceed_parity")
    page.flag(f"{p} + {lost} > {g}", [of("gravidity"), of("parity"), of("anomaly.abortion.count")], "gravidity_lt_parity_plus_abortions")
    for k in range(1, 6):
        page.blank(f"{p} < {k}", [of(f"prev{k}.{row}") for row in PREVIOUS], "beyond_parity")
        page.blank(f"{page.value(of(f'prev{k}.mode'))} in ('vaginal', 'instrumental')", [of(f"prev{k}.cs_indication")], "not_a_cesarean")
    for what in ("rubella", "hepb"):
        page.blank(f"not {page.ticked(of(what + '_vaccinated'))}", [of(what + "_date")], "not_vaccinated")


def _delivery(page: Page) -> None:
    of = lambda x: f"delivery.{x}"
    planned, urgent, vaginal, helped = (page.ticked(of(f"mode.{x}")) for x in ("cesarean_planned", "cesarean_emergency", "vaginal", "instrumental"))
    # A tri-state: true if the first is, else what the second says, null included.
    cesarean = f"if(coalesce({planned}, false), true, {urgent})"
    page.blank(f"(coalesce({vaginal}, false) or coalesce({helped}, false)) and not coalesce({cesarean}, false)", [of("cesarean_indication")], "not_a_cesarean")
    page.flag(f"not {cesarean} and {page.value(of('cesarean_indication'))} <> ''", [of("cesarean_indication")], "indication_without_cesarean")
    for x in ("newborn.weight", "newborn.head_circumference"):
        page.blank(f"{page.ticked(of('newborn_status.stillborn'))} and {page.value(of(x))} is null", [of(x)], "stillborn")
    page.flag(f"{page.number(of('newborn.gest_age'))} >= 37 and {page.number(of('newborn.weight'))} < 1500", [of("newborn.weight"), of("newborn.gest_age")], "birth_weight_inconsistent_with_term")


def _mother(when: str):
    def rules(page: Page) -> None:
        page.pressure(f"{when}.bp")
        page.blank(f"not {page.ticked(f'{when}.cesarean')}", [f"{when}.scar_state"], "not_a_cesarean")
        page.blank(f"not {page.ticked(f'{when}.medication_intake')}", [f"{when}.medication_details"], "no_medication")

    return rules


def _newborn(when: str):
    return lambda page: page.blank(f"not {page.ticked(f'{when}.transfer')}", [f"{when}.referral_facility"], "no_transfer")


RULES = {"pregnancy": _pregnancy, "history": _history, "delivery": _delivery}
RULES |= {f"pp_{when}_mother": _mother(f"pp_{when}_mother") for when in ("early", "late")}
RULES |= {f"pp_{when}_newborn": _newborn(f"pp_{when}_newborn") for when in ("early", "late")}


def _effects(rules: dict[str, list[tuple[str, list[str], str]]]) -> str:
    """SQL for the (id, mark) pairs that the rules of the page's type give."""
    cases = []
    for page_type, own in rules.items():
        parts = [f"if({when}, array({', '.join(f"struct('{n}' as id, '{mark}' as mark)" for n in names)}), null)" for when, names, mark in own]
        if parts:
            cases.append(f"when '{page_type}' then flatten(array_compact(array({', '.join(parts)})))")
    return f"coalesce(case page_type {' '.join(cases)} end, cast(array() as array<struct<id: string, mark: string>>))"


def apply_rules(rows: DataFrame) -> DataFrame:
    """Field rows (page, page_type, field, status, value, source, flags, exclusive_group) after the rules of their page.

    Values are canonical strings: ISO dates, 120/80, decimal numbers, true and false. KNOWN and NEEDS_REVIEW rows say
    something, a box is ticked only if KNOWN. A rule whose fields say nothing doesn't hold. Flags are added
    once, after those there; of reasons for a blank the first counts, and its source becomes `rule`.
    Ticked boxes of one exclusive group get several_options_ticked if they are several. Of rows
    that repeat a field the least by status and value speaks, and all get the marks. Pages of a null or
    unknown type have only the exclusive groups; a null page is one page. An empty table gives an empty result.
    """
    columns: dict[str, str] = {}
    pages = {page_type: Page(columns) for page_type in RULES}
    for page_type, rules in RULES.items():
        rules(pages[page_type])
    kept = [c for c in rows.columns if c not in ("page", "page_type")]
    said = F.when(F.col("status").isin("KNOWN", "NEEDS_REVIEW"), F.col("value"))
    ticked = F.when(F.col("status") == "KNOWN", ~F.coalesce("value", F.lit("")).isin("", "false", "0", "0.0"))
    facts = F.struct(F.col("field").alias("id"), "status", "value", said.alias("said"), ticked.alias("ticked"))
    gathered = rows.groupBy("page", "page_type").agg(F.sort_array(F.collect_list(facts)).alias("__rows"), F.collect_list(F.struct(*kept)).alias("__all"))
    gathered = gathered.withColumns({name: F.expr(expression) for expression, name in columns.items()})
    gathered = gathered.withColumns({"__flags": F.expr(_effects({t: p.flags for t, p in pages.items()})), "__blanks": F.expr(_effects({t: p.blanks for t, p in pages.items()}))})
    several = F.expr("map_from_entries(transform(array_distinct(filter(transform(__all, r -> r.exclusive_group), g -> g is not null)), g -> struct(g, size(filter(__all, r -> r.exclusive_group = g and r.value = 'true')) > 1)))")
    flat = gathered.withColumn("__several", several).select("page", "page_type", "__flags", "__blanks", "__several", F.explode("__all").alias("__r"))
    marks = "transform(filter({}, x -> x.id = __r.field), x -> x.mark)"
    grouped = "if(__r.value = 'true' and element_at(__several, __r.exclusive_group), array('several_options_ticked'), cast(array() as array<string>))"
    flat = flat.withColumn("__new", F.expr(f"concat({grouped}, {marks.format('__flags')})")).withColumn("__reason", F.expr(f"if(__r.status = 'NOT_PROVIDED', get({marks.format('__blanks')}, 0), null)"))
    old = F.coalesce(F.col("__r.flags"), F.array().cast("array<string>"))
    reason = F.when(F.col("__reason").isNotNull(), F.array(F.concat(F.lit("not_applicable:"), "__reason"))).otherwise(F.array().cast("array<string>"))
    changed = {
        "status": F.when(F.col("__reason").isNotNull(), "NOT_APPLICABLE").otherwise(F.col("__r.status")),
        "source": F.when(F.col("__reason").isNotNull(), "rule").otherwise(F.col("__r.source")),
        "flags": F.concat(old, F.array_except(F.col("__new"), old), reason),
    }
    return flat.select(*(changed[c].alias(c) if c in changed else c if c in ("page", "page_type") else F.col("__r")[c].alias(c) for c in rows.columns))
