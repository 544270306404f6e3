"""Explicit schemas of the engine's logical tables; nothing is inferred."""

CATALOGUE = "name string, description string, body string, path string, category string, tags array<string>, token_cost_meta bigint, token_cost_body bigint, rowid bigint"
SESSION_LOG = "id bigint, session_id string, skill_name string, query string, timestamp timestamp_ntz, success boolean"
SESSION_EVENTS = "session_id string, event string, timestamp timestamp_ntz, metadata string"
FEEDBACK_LOG = "id bigint, query string, skill_name string, success boolean, latency_ms bigint, user_rating int, timestamp timestamp_ntz"
USAGE_LOG = "id bigint, timestamp timestamp_ntz, skill_name string, query string, retrieval_method string, score double, tokens_saved bigint, latency_ms bigint"
EDGES = "src string, dst string, weight double, edge_type string"
RECIPES = "recipe string, description string, must array<string>, should array<string>"
