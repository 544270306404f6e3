"""The reading tools as SQL table functions: SELECT * FROM skill_neighbors('name', 5).

register() makes temporary views of an engine's tables and temporary functions over them, for its session. Views show the
catalogue and logs as they are then: register again after a load. Arguments are constants, so that Spark turns a rank's bound
into a limit before the sort. A query's search has no function here: it takes its queries as a table (Engine.query)."""

from __future__ import annotations

from quern.plans.engine import Engine

#: By name: parameters, columns, and the query; a parameter stands as function.parameter.
FUNCTIONS = {
    "skill_list": (
        "category STRING DEFAULT NULL, k INT DEFAULT 1000", "rank INT, name STRING, category STRING, use_count BIGINT",
        """SELECT rank, name, category, use_count FROM (
             SELECT c.name, c.category, coalesce(u.n, 0) AS use_count, row_number() OVER (ORDER BY coalesce(u.n, 0) DESC, c.rowid) AS rank
             FROM {p}catalogue c LEFT JOIN (SELECT skill_name, count(*) AS n FROM {p}uses GROUP BY skill_name) u ON u.skill_name = c.name
             WHERE skill_list.category IS NULL OR c.category = skill_list.category)
           WHERE rank <= skill_list.k""",
    ),
    "skill_stats": (
        "", "category STRING, cnt BIGINT, meta_tokens BIGINT, body_tokens BIGINT",
        "SELECT category, count(*), sum(token_cost_meta), sum(token_cost_body) FROM {p}catalogue GROUP BY category",
    ),
    "skill_neighbors": (
        "name STRING, k INT DEFAULT 20, edge_type STRING DEFAULT NULL", "rank INT, name STRING, weight DOUBLE, edge_type STRING",
        """SELECT rank, dst, weight, edge_type FROM (
             SELECT e.dst, e.weight, e.edge_type, row_number() OVER (ORDER BY e.weight DESC, e.dst, e.edge_type) AS rank FROM {p}edges e
             WHERE e.src = skill_neighbors.name AND (skill_neighbors.edge_type IS NULL OR e.edge_type = skill_neighbors.edge_type))
           WHERE rank <= skill_neighbors.k""",
    ),
    "skill_recipe": (
        "recipe STRING, include_should BOOLEAN DEFAULT TRUE", "pos INT, name STRING, tokens BIGINT, total_tokens BIGINT",
        """SELECT pos, w.name, c.token_cost_body, sum(c.token_cost_body) OVER () FROM (
             SELECT posexplode(CASE WHEN skill_recipe.include_should THEN concat(must, should) ELSE must END) AS (pos, name)
             FROM {p}recipes r WHERE r.recipe = skill_recipe.recipe) w JOIN {p}catalogue c ON c.name = w.name""",
    ),
    "skill_recent": (
        "session STRING, n INT DEFAULT 5", "place INT, skill_name STRING, id BIGINT",
        """SELECT place, skill_name, id FROM (
             SELECT skill_name, id, row_number() OVER (ORDER BY timestamp DESC, id DESC) AS place FROM (
               SELECT skill_name, max(id) AS id, max_by(timestamp, id) AS timestamp FROM {p}session_uses WHERE session_id = skill_recent.session GROUP BY skill_name))
           WHERE place <= skill_recent.n""",
    ),
    "skill_rates": (
        "k INT DEFAULT 10", "rank INT, skill_name STRING, successes BIGINT, failures BIGINT, rate DOUBLE",
        """SELECT rank, skill_name, successes, n - successes, round(successes / n, 3) FROM (
             SELECT skill_name, successes, n, row_number() OVER (ORDER BY successes / n DESC, skill_name) AS rank FROM (
               SELECT skill_name, count_if(coalesce(success, false)) AS successes, count(*) AS n FROM {p}feedback GROUP BY skill_name))
           WHERE rank <= skill_rates.k""",
    ),
    "skill_top": (
        "as_of TIMESTAMP_NTZ, days INT DEFAULT 30, k INT DEFAULT 10", "rank INT, skill_name STRING, cnt BIGINT",
        """SELECT rank, skill_name, cnt FROM (
             SELECT skill_name, cnt, row_number() OVER (ORDER BY cnt DESC, skill_name) AS rank FROM (
               SELECT skill_name, count(*) AS cnt FROM {p}usage WHERE timestamp > skill_top.as_of - make_dt_interval(skill_top.days) GROUP BY skill_name))
           WHERE rank <= skill_top.k""",
    ),
}


def register(engine: Engine, prefix: str = "skill_view_") -> list[str]:
    """Make the views and functions in the engine's session; returns the functions' names. A later call takes an earlier one's place."""
    session_uses, usage = engine.table("session_skills"), engine.table("usage_events")
    views = {
        "catalogue": engine.table("skills"), "session_uses": session_uses, "usage": usage, "feedback": engine.table("feedback"),
        "uses": usage.select("skill_name").unionByName(session_uses.select("skill_name")), "recipes": engine.table("recipes"), "edges": engine.edges(),
    }
    for name, table in views.items():
        table.createOrReplaceTempView(f"{prefix}{name}")
    for name, (parameters, columns, body) in FUNCTIONS.items():
        engine.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE({columns}) RETURN {body.replace('{p}', prefix)}")
    return list(FUNCTIONS)
