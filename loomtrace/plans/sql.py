"""Common table expressions shared by the SQL equivalents."""

TURNS = """turns AS (
 SELECT row_id, user_id, conv_id, turn_id, conv_starter, reasoning, thinking, thoughts, tools, interactions, month,
  CASE WHEN lower(trim(platform)) IN ('chatgpt','grok','claude','deepseek') THEN lower(trim(platform)) ELSE split_part(conv_id, '_', 1) END AS platform,
  CASE WHEN topic IS NULL OR trim(topic) IN ('', 'nan') THEN 'Other' ELSE trim(topic) END AS topic, lower(trim(language)) AS language,
  openai_models AS models, user_msg_history AS users, assistant_msg_history AS answers,
  coalesce(list_filter(openai_models, lambda m: m IS NOT NULL AND trim(m) <> '')[-1], 'Unknown') AS primary_model,
  coalesce(len(list_filter(tools, lambda t: contains(lower(coalesce(t,'')), 'web'))) > 0, false) OR coalesce(len(list_filter(interactions, lambda t: contains(lower(coalesce(t,'')), 'web'))) > 0, false) AS web,
  list_filter(user_msg_history, lambda u: u IS NOT NULL AND trim(u) <> '')[-1] AS last_user
 FROM web_data_summary)"""


def as_list(x: str) -> str:
    """The list an expression holds as JSON list, JSON text or single object."""
    inner = f"(CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x} ->> '$') THEN ({x} ->> '$')::JSON ELSE {x} END)"
    return f"(CASE json_type({inner}) WHEN 'ARRAY' THEN {inner}::JSON[] WHEN 'OBJECT' THEN [{inner}] END)"


def unnest(name: str, source: str, columns: str, lists: str, index: str, value: str) -> str:
    return f"{name} AS (SELECT {columns}, generate_subscripts(l, 1) - 1 AS {index}, unnest(l) AS {value} FROM (SELECT *, {lists} AS l FROM {source}))"


MESSAGES = (
    "valid AS (SELECT row_id, CASE WHEN json_valid(turn_msgs) THEN turn_msgs::JSON END AS v FROM web_data_summary),\n"
    + unnest("msgs", "valid", "row_id", "CASE WHEN json_type(v) = 'ARRAY' THEN v::JSON[] END", "pos", "m")
)
QUERIES = (
    MESSAGES
    + """,
query_lists AS (SELECT row_id, pos, list_filter(list_concat(coalesce(list_transform("""
    + as_list("(m -> '$.metadata.search_queries')")
    + """, lambda x: x ->> '$.q'), []), coalesce((m -> '$.metadata.search_model_queries.queries')::VARCHAR[], [])), lambda q: q IS NOT NULL AND q <> '') AS qs FROM msgs),
queries AS (SELECT DISTINCT row_id, pos, unnest(qs) AS q FROM query_lists),
loops AS (SELECT row_id, pos, count(*) AS n_queries, list_sort(list(q)) AS queries, row_number() OVER (PARTITION BY row_id ORDER BY pos) AS loop_idx FROM queries GROUP BY row_id, pos)"""
)
#: What every search loop stands on: needs QUERIES.
CONTEXT = (
    """told AS (SELECT row_id, pos,
  CASE WHEN (m ->> '$.content.content_type') = 'thoughts' THEN list_transform("""
    + as_list("(m -> '$.content.thoughts')")
    + """, lambda x: coalesce(x ->> '$.content', '')) ELSE [] END AS t,
  list_concat(coalesce(flatten(list_transform("""
    + as_list("(m -> '$.metadata.search_result_groups')")
    + """, lambda g: list_transform(list_filter("""
    + as_list("(g -> '$.entries')")
    + """, lambda x: json_type(x) = 'OBJECT'), lambda x: coalesce(x ->> '$.title', '') || chr(10) || coalesce(g ->> '$.domain', '') || chr(10) || coalesce(x ->> '$.snippet', '')))), []),
   coalesce(list_transform(list_filter("""
    + as_list("(m -> '$.metadata.image_results')")
    + """, lambda x: json_type(x) = 'OBJECT'), lambda x: coalesce(x ->> '$.title', '') || chr(10) || chr(10) || coalesce(x ->> '$.snippet', '')), [])) AS s,
  CASE WHEN trim(coalesce(m ->> '$.metadata.user_context_message_data.about_user_message', '')) <> '' THEN [m ->> '$.metadata.user_context_message_data.about_user_message'] ELSE [] END AS mem
 FROM msgs),
told_loop AS (SELECT told.*, coalesce(sum((l.row_id IS NOT NULL)::INT) OVER (PARTITION BY told.row_id ORDER BY told.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS loop_idx FROM told LEFT JOIN loops l ON l.row_id = told.row_id AND l.pos = told.pos),
context AS (SELECT a.row_id, a.loop_idx::INT AS loop_idx, any_value(l.queries) AS queries, coalesce(flatten(list(a.t ORDER BY a.pos)), []) AS thoughts, flatten(list(a.s ORDER BY a.pos)) AS sources, flatten(list(a.mem ORDER BY a.pos)) AS memories
 FROM told_loop a JOIN loops l ON l.row_id = a.row_id AND l.loop_idx = a.loop_idx GROUP BY 1, 2)"""
)
_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '(\\p{{L}}+|\\d+)')"


def words_of(lists: str) -> str:
    """Distinct words of a list of texts."""
    return f"list_distinct(flatten(list_transform({lists}, lambda y: {_TOK.format('y')})))"


#: Where the words of each loop's queries come from, and per turn: needs TURNS, QUERIES and CONTEXT.
PROVENANCE = (
    "bag AS (SELECT row_id, loop_idx, "
    + words_of("queries")
    + " AS w, "
    + words_of("memories")
    + " AS mw, "
    + words_of("sources")
    + " AS sw, list_distinct("
    + _TOK.format("users[-1]")
    + ") AS uw, "
    + words_of("list_concat(coalesce(users[:-2], []), coalesce(answers, []))")
    + """ AS hw FROM context JOIN turns USING (row_id)),
tier AS (SELECT row_id, loop_idx, unnest(w) AS word, uw, hw, mw, sw FROM bag),
placed AS (SELECT row_id, loop_idx, word, CASE WHEN list_contains(uw, word) THEN 'user' WHEN list_contains(hw, word) THEN 'history' WHEN list_contains(mw, word) THEN 'memories' WHEN list_contains(sw, word) THEN 'sources' ELSE 'model' END AS origin FROM tier),
origin AS (SELECT row_id, max(loop_idx) AS n_loops, """
    + ", ".join(f"coalesce(list(DISTINCT word) FILTER (WHERE origin = '{x}'), []) AS {y}" for x, y in (("user", "user_words"), ("history", "history_words"), ("memories", "memory_words"), ("sources", "source_words"), ("model", "model_words")))
    + " FROM placed GROUP BY 1)"
)
_NO_UTM = "regexp_replace(regexp_replace(trim({0}), '\\?utm_source=chatgpt\\.com$', ''), '&utm_source=chatgpt\\.com$', '')"
KEY = "regexp_replace(" + _NO_UTM + ", '/+$', '')"
DOMAIN = "(SELECT CASE WHEN x LIKE '%.wikipedia.org' THEN 'wikipedia.org' ELSE x END FROM (SELECT regexp_replace(regexp_replace(lower(trim(replace(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), 'www.', ''))), '\\.+$', ''), '^www\\.', '') AS x))"
_MARK = "[A-Za-z]+(\\d+)[A-Za-z]+(\\d+)[]"
SOURCES = (
    MESSAGES
    + ",\n"
    + unnest("groups_", "msgs", "row_id, pos", as_list("(m -> '$.metadata.search_result_groups')"), "g", "gv")
    + ",\n"
    + unnest("entries", "groups_", "row_id, pos, g", as_list("(gv -> '$.entries')"), "e", "ev")
    + ",\n"
    + unnest("images", "msgs", "row_id, pos", as_list("(m -> '$.metadata.image_results')"), "e", "ev")
    + """,
retrieved AS (
 SELECT row_id, pos, g, e, ev ->> '$.url' AS url, ev ->> '$.title' AS title, ev ->> '$.snippet' AS snippet, (ev ->> '$.ref_id.turn_index')::INT AS turn_index, (ev ->> '$.ref_id.ref_index')::INT AS ref_index FROM entries WHERE ev ->> '$.url' <> ''
 UNION ALL SELECT row_id, pos, 1000000, e, ev ->> '$.url', ev ->> '$.title', ev ->> '$.snippet', NULL, e::INT FROM images WHERE ev ->> '$.url' <> ''),
"""
    + unnest("safe_all", "msgs", "row_id, pos", "CASE WHEN json_type(m -> '$.metadata.safe_urls') = 'ARRAY' THEN (m -> '$.metadata.safe_urls')::VARCHAR[] END", "e", "u")
    + ",\nsafe AS (SELECT row_id, pos, e, "
    + _NO_UTM.format("u")
    + " AS url FROM safe_all WHERE u <> ''),\n"
    + unnest("refs_all", "msgs", "row_id, pos", as_list("(m -> '$.metadata.content_references')"), "c", "cv")
    + ",\nmarked AS (SELECT *, "
    + as_list("(cv -> '$.refs')")
    + " AS own, regexp_extract(cv ->> '$.matched_text', '[^]*') AS mark FROM refs_all WHERE regexp_matches(cv ->> '$.matched_text', '[^]*"
    + _MARK
    + "')),\n"
    + unnest("items_", "(SELECT *, 1 AS src, " + as_list("(cv -> '$.images')") + " AS il FROM marked UNION ALL SELECT *, 2, CASE WHEN len(" + as_list("(cv -> '$.fallback_items')") + ") > 0 THEN " + as_list("(cv -> '$.fallback_items')") + " ELSE " + as_list("(cv -> '$.items')") + " END FROM marked)", "row_id, pos, c, own, src", "il", "i", "iv")
    + """,
cited_all AS (
 SELECT row_id, pos, c, 0 AS src, 0 AS i, cv ->> '$.url' AS url, cv ->> '$.title' AS title, cv ->> '$.snippet' AS snippet, regexp_extract(mark, '"""
    + _MARK
    + """', 1)::INT AS turn_index, regexp_extract(mark, '"""
    + _MARK
    + """', 2)::INT AS ref_index FROM marked
 UNION ALL
 SELECT row_id, pos, c, src, i, iv ->> '$.url', iv ->> '$.title', iv ->> '$.snippet',
  CASE WHEN f IS NOT NULL THEN (f ->> '$.turn_index')::INT ELSE (own[i + 1] ->> '$.turn_index')::INT END, CASE WHEN f IS NOT NULL THEN (f ->> '$.ref_index')::INT ELSE (own[i + 1] ->> '$.ref_index')::INT END
 FROM (SELECT *, ("""
    + as_list("(iv -> '$.refs')")
    + """)[1] AS f FROM items_)),
cited_ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id, url, turn_index, ref_index ORDER BY (trim(coalesce(title, '')) <> '')::INT + (trim(coalesce(snippet, '')) <> '')::INT DESC, pos, c, src, i) AS n FROM cited_all WHERE url <> ''),
cited AS (SELECT row_id, pos, url, title, turn_index, ref_index FROM cited_ranked WHERE n = 1),
source_keys AS (SELECT DISTINCT row_id, kind, """
    + KEY.format("url")
    + " AS key, "
    + DOMAIN.format("url")
    + """ AS domain FROM (SELECT row_id, 'retrieved' AS kind, url FROM retrieved UNION ALL SELECT row_id, 'safe', url FROM safe UNION ALL SELECT row_id, 'cited', url FROM cited)),
url_sets AS (SELECT row_id, coalesce(list(key) FILTER (WHERE kind = 'retrieved'), []) AS retrieved, coalesce(list(key) FILTER (WHERE kind = 'safe'), []) AS safe, coalesce(list(key) FILTER (WHERE kind = 'cited'), []) AS cited
 FROM (SELECT DISTINCT row_id, kind, key FROM source_keys) GROUP BY row_id)"""
)


#: A whole citation mark, and the sentences of a text by a sign set in place of each gap, as SQL has no look-around.
OUTER_MARK = "\ue200[^\ue201]*\ue202[A-Za-z]+\\d+[A-Za-z]+\\d+(?:\ue202[^\ue201]*)?\ue201"
SENTENCES = "list_filter(list_transform(string_split(regexp_replace(coalesce({0}, ''), '([.!?])[ \\t\\n\\x0B\\f\\r]+([`''*_\"(\\[]*[A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_replace(regexp_replace(s, '^[ \\-*\\t\\n]+', ''), '[ \\-*\\t\\n]+$', '')), lambda s: length(s) >= 8 AND regexp_matches(s, '\\p{{L}}'))"
REFS = "list_transform(list_filter(string_split(replace({0}, chr(57857), ''), chr(57858)), lambda x: regexp_full_match(x, '[A-Za-z]+\\d+[A-Za-z]+\\d+')), lambda x: regexp_extract(x, '^[A-Za-z]+(\\d+)', 1)::INT || '::' || regexp_extract(x, '(\\d+)$', 1)::INT)"
#: Pieces of answers that citation marks close: (doc_id, ord, text, refs).
CHUNKS = (
    "answer AS (SELECT doc_id, text, string_split(regexp_replace(text, '" + OUTER_MARK + "', chr(2), 'g'), chr(2)) AS seg, regexp_extract_all(text, '" + OUTER_MARK + "') AS marks FROM documents WHERE doc_kind = 'answer' AND text IS NOT NULL),\n"
    "segment AS (SELECT doc_id, i, " + SENTENCES.format("s") + " AS said, mark FROM (SELECT doc_id, generate_subscripts(seg, 1) AS i, unnest(seg) AS s, unnest(list_concat(marks, [NULL])) AS mark FROM answer)),\n"
    "grouped AS (SELECT *, sum((len(said) > 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM segment WHERE mark IS NOT NULL),\n"
    "ref AS (SELECT doc_id, grp, i, generate_subscripts(r, 1) AS j, unnest(r) AS r, row_number() OVER () AS _ FROM (SELECT doc_id, grp, i, " + REFS.format("mark") + " AS r FROM grouped WHERE grp > 0)),\n"
    "ref_once AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp, r ORDER BY i, j) AS k, min(i) OVER (PARTITION BY doc_id, grp) AS first FROM ref),\n"
    "marked_chunk AS (SELECT g.doc_id, g.i AS ord, array_to_string(g.said, ' ') AS text, (SELECT string_agg(r, ';' ORDER BY i, j) FROM ref_once o WHERE o.doc_id = g.doc_id AND o.grp = g.grp AND (o.k = 1 OR o.i = o.first)) AS refs FROM grouped g WHERE len(g.said) > 0),\n"
    "tail AS (SELECT doc_id, i + generate_subscripts(said, 1) AS ord, unnest(said) AS text, '' AS refs FROM segment WHERE mark IS NULL),\n"
    "found AS (SELECT * FROM marked_chunk UNION ALL SELECT * FROM tail),\n"
    "chunk AS (SELECT * FROM found UNION ALL SELECT doc_id, generate_subscripts(s, 1), unnest(s), '' FROM (SELECT doc_id, " + SENTENCES.format("text") + " AS s FROM answer WHERE doc_id NOT IN (SELECT doc_id FROM found)))"
)
TURN_SETS = """turn_sets AS (SELECT turns.*, coalesce(retrieved, []) AS retrieved, coalesce(safe, []) AS safe, coalesce(cited, []) AS cited FROM turns LEFT JOIN url_sets USING (row_id))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
