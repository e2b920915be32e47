"""The stored queries as SQL table functions, so that SQL users call them by name, laterally too.

``register`` gives the tables names and creates temporary functions over them:

    SELECT * FROM daily_plan_of(DATE'2024-08-04')
    SELECT d.day, p.* FROM days d, LATERAL daily_plan_of(d.day) p
    SELECT field_interval(DATE'2024-08-04', 3)
    SELECT * FROM default_plan_of(DATE'2024-08-04')      -- what an untouched day would get
    SELECT * FROM harvest_history(300)
    SELECT * FROM harvests_on(DATE'2024-08-04')
    SELECT * FROM weather_status(DATE'2024-07-01', DATE'2024-07-31')

Catalyst puts a function's query in place of each call and turns lateral calls into joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from furrow.functions import expressions as E
from furrow.operators import harvests as H
from furrow.plans import daily as P

_TOTAL = " + ".join(H.GRADES)
_COMPLETE = " AND ".join(f"w.{c} IS NOT NULL" for c, _ in E.COMPLETE_COLUMNS)
_MISSING = ", ".join(f"CASE WHEN w.{c} IS NULL THEN '{name}' END" for c, name in E.COMPLETE_COLUMNS)

_STALEST = "row_number() OVER (ORDER BY max(h.harvest_date) NULLS FIRST, f.id)"

FUNCTIONS = {
    "default_plan_of": f"""(on_day DATE) RETURNS TABLE (plan_date DATE, field_id INT, position INT) RETURN
        SELECT on_day, r.id, r.place FROM (SELECT 1 AS one, f.id, {_STALEST} AS place FROM {{fields}} f LEFT JOIN {{harvests}} h ON h.field_id = f.id GROUP BY f.id) r
        LEFT ANTI JOIN (SELECT DISTINCT 1 AS one FROM {{plan}} p WHERE p.plan_date = on_day) s ON s.one = r.one WHERE r.place <= {P.DEFAULT_ROWS}""",
    "harvests_on": """(on_day DATE) RETURNS TABLE (field_id INT, interval_days INT, a DECIMAL(12,2), b DECIMAL(12,2), c DECIMAL(12,2), xl DECIMAL(12,2)) RETURN
        SELECT field_id, interval_days, a, b, c, xl FROM {harvests} WHERE harvest_date = on_day""",
    "field_interval": """(on_day DATE, field INT) RETURNS INT RETURN
        SELECT coalesce(
            datediff(on_day, (SELECT max(h.harvest_date) FROM {harvests} h WHERE h.field_id = field AND h.harvest_date < on_day)),
            (SELECT max(CASE WHEN pmod(p.position - 1, 3) = 2 THEN 4 ELSE 5 END) FROM {plan} p WHERE p.plan_date = on_day AND p.field_id = field),
            5)""",
    "daily_plan_of": """(on_day DATE) RETURNS TABLE (field_id INT, field_name STRING, position INT, interval_days INT) RETURN
        SELECT p.field_id, f.name, p.position, coalesce(datediff(p.plan_date, max(h.harvest_date)), CASE WHEN pmod(p.position - 1, 3) = 2 THEN 4 ELSE 5 END)
        FROM {plan} p JOIN {fields} f ON f.id = p.field_id LEFT JOIN {harvests} h ON h.field_id = p.field_id AND h.harvest_date < p.plan_date
        WHERE p.plan_date = on_day GROUP BY p.plan_date, p.field_id, f.name, p.position""",
    "harvest_history": f"""(rows INT) RETURNS TABLE (harvest_date DATE, field_name STRING, interval_days INT, a DECIMAL(12,2), b DECIMAL(12,2), c DECIMAL(12,2), xl DECIMAL(12,2), total DECIMAL(15,2)) RETURN
        SELECT harvest_date, name, interval_days, a, b, c, xl, CAST({_TOTAL} AS DECIMAL(15,2))
        FROM (SELECT *, row_number() OVER (ORDER BY harvest_date DESC, field_id) AS place FROM {{harvests}}) JOIN {{fields}} ON id = field_id
        WHERE place <= greatest(1, least({H.HISTORY_MOST}, coalesce(rows, {H.HISTORY_MOST})))""",
    "weather_status": f"""(first_day DATE, last_day DATE) RETURNS TABLE (weather_date DATE, is_complete BOOLEAN, missing STRING) RETURN
        SELECT s.day, {_COMPLETE}, concat_ws(', ', {_MISSING})
        FROM (SELECT explode(CASE WHEN first_day <= last_day THEN sequence(first_day, last_day) ELSE array() END) AS day) s LEFT JOIN {{weather}} w ON w.weather_date = s.day""",
}


def register(spark: SparkSession, fields: DataFrame, plan: DataFrame, harvests: DataFrame, weather: DataFrame, prefix: str = "furrow") -> None:
    """Creates the functions in the session, over these tables as they are."""
    names = {"fields": fields, "plan": plan, "harvests": harvests, "weather": weather}
    for name, table in names.items():
        table.createOrReplaceTempView(f"{prefix}_{name}")
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name} {body.format(**{n: f'{prefix}_{n}' for n in names})}")
