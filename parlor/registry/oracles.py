"""The same queries as DuckDB SQL over the driver tables."""

from __future__ import annotations

# Whitespace as a list of code points, and as a character class.
WS_CHARS = "||".join(
    f"chr({c})"
    for c in [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
)
WS = r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def word(names: str) -> str:
    return r"(^|[^\p{L}\p{N}_])(" + names + r")($|[^\p{L}\p{N}_])"


def like(text: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({text}, '{pattern}', 'i'), false)"


def strip(text: str) -> str:
    return f"trim({text}, {WS_CHARS})"


def clean(text: str) -> str:
    no_mentions = rf"regexp_replace(coalesce({text}, ''), '(@mail7\b|@[0-9]+\b)', '', 'gi')"
    return f"trim(regexp_replace({no_mentions}, '{WS}+', ' ', 'g'))"


def collapsed(text: str) -> str:
    return f"trim(regexp_replace(coalesce({text}, ''), '{WS}+', ' ', 'g'))"


def word_count(text: str) -> str:
    return f"CASE WHEN {collapsed(text)} = '' THEN 0 ELSE len(string_split({collapsed(text)}, ' ')) END"


def any_of(text: str, *terms: str) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), '{t}')" for t in terms) + ")"


def key(id_: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || CAST({id_} AS VARCHAR))"


def share(part: str, whole: str) -> str:
    return f"coalesce(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0), 0.0)"


BOILERPLATE = word("nicht|les|los|thing")
FRENCH, GERMAN, SPANISH, ENGLISH = word("les|des|est"), word("der|die|und"), word("los|las|el"), word("the|and|of")
ESCALATE = word("nicht|that|los")
GENERIC = "Thanks for reaching out, please DM your confirmation number so we can help."


def language(text: str, default: str = "other") -> str:
    return (
        f"CASE WHEN {like(text, FRENCH)} THEN 'french' WHEN {like(text, GERMAN)} THEN 'german' "
        f"WHEN {like(text, SPANISH)} THEN 'spanish' WHEN {like(text, ENGLISH)} THEN 'english' ELSE '{default}' END"
    )


def template(which: str) -> str:
    return f"""CASE {which} WHEN 'french' THEN 'Sorry about that, please send us your confirmation code by DM.'
        WHEN 'german' THEN 'Glad to help, a dollar amount needs an agent.'
        WHEN 'spanish' THEN 'We understand.' ELSE '{GENERIC}' END"""


def label(text: str, which: str, confidence: str, field: str) -> str:
    rungs = [
        (any_of(text, "licens", "copyright", "sue"), "legal"),
        (any_of(text, "@", "http"), "contact"),
        (f"({any_of(text, 'nung', 'keit')} AND {which} = 'german')", "money"),
        (f"({which} = 'other' AND {confidence} < 0.40)", "ambiguous_intent"),
    ]
    value = (lambda reason: "escalate") if field == "decision" else (lambda reason: reason)
    last = "auto_handle" if field == "decision" else "standard_operational_resolution"
    return "CASE " + " ".join(f"WHEN {t} THEN '{value(r)}'" for t, r in rungs) + f" ELSE '{last}' END"


THREADS = f"""
    turns AS (
        SELECT conv_id, turn, role, {clean('text')} AS body
        FROM conversations WHERE role IN ('user', 'assistant')),
    sides AS (
        SELECT conv_id,
               arg_min(body, turn) FILTER (WHERE role = 'user') AS customer_message,
               arg_min(body, turn) FILTER (WHERE role = 'assistant') AS agent_reply,
               count(*) AS turns_count,
               count(*) FILTER (WHERE role = 'user') AS num_customer_turns,
               count(*) FILTER (WHERE role = 'assistant') AS num_support_turns
        FROM turns WHERE body <> '' GROUP BY conv_id),
    threads AS (
        SELECT 'conv_' || CAST(conv_id AS VARCHAR) AS thread_id, customer_message, agent_reply, turns_count,
               num_customer_turns, num_support_turns, {like('agent_reply', BOILERPLATE)} AS is_boilerplate
        FROM sides
        WHERE num_customer_turns > 0 AND num_support_turns > 0
          AND length(customer_message) >= 8 AND length(agent_reply) >= 8)"""

LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"

PAIR_BLOCKS = """
        SELECT CAST(c.conv_id AS VARCHAR) || ':' || CAST(c.turn AS VARCHAR) AS block_id,
               c.role || ': ' || c.text || coalesce(chr(10) || n.role || ': ' || n.text, '') AS transcript
        FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1"""
WHOLE_BLOCKS = """
        SELECT CAST(conv_id AS VARCHAR) AS block_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript
        FROM conversations GROUP BY conv_id"""


def parsed(blocks: str) -> str:
    return f"""
    blocks AS ({blocks}),
    split_lines AS (
        SELECT block_id, string_split_regex(transcript, '{LINE_BREAK}') AS lines FROM blocks),
    numbered AS (
        SELECT block_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM split_lines),
    kept AS (
        SELECT block_id, pos, {strip('line')} AS line FROM numbered WHERE {strip('line')} <> ''),
    marked AS (
        SELECT block_id, pos, line,
               CASE WHEN starts_with(lower(line), 'user:') THEN 'customer'
                    WHEN starts_with(lower(line), 'assistant:') THEN 'support' END AS opens
        FROM kept),
    segmented AS (
        SELECT *, sum(CASE WHEN opens IS NOT NULL THEN 1 ELSE 0 END)
                  OVER (PARTITION BY block_id ORDER BY pos) AS segment
        FROM marked),
    joined AS (
        SELECT block_id, segment, max(opens) AS role,
               string_agg(CASE opens WHEN 'customer' THEN substr(line, 6) WHEN 'support' THEN substr(line, 11) ELSE line END,
                          ' ' ORDER BY pos) AS body
        FROM segmented WHERE segment > 0 GROUP BY block_id, segment),
    parsed AS (
        SELECT block_id, segment, role, {clean('body')} AS body FROM joined WHERE {clean('body')} <> '')"""


PARSED = parsed(PAIR_BLOCKS)

CENTROIDS = """
    elements AS (
        SELECT CAST(label AS VARCHAR) AS class, unnest(CAST(embedding AS DOUBLE[])) AS value,
               unnest(range(len(embedding))) AS position FROM embeddings),
    means AS (SELECT class, position, avg(value) AS value FROM elements GROUP BY class, position),
    norms AS (SELECT class, sqrt(sum(value * value)) AS size FROM means GROUP BY class),
    centroids AS (
        SELECT m.class, list(m.value / n.size ORDER BY m.position) AS centroid
        FROM means m JOIN norms n USING (class) GROUP BY m.class)"""

VECTOR_TERMS = {
    "0": ["ation", "ung"], "1": ["mente"], "2": ["nicht", "sue"], "3": ["eaux"], "4": ["thing"],
    "5": ["los"], "6": ["que"], "7": ["ß"], "8": ["tion"], "9": ["ñ", "der"],
}


def vector_hit(which: str) -> str:
    return "CASE " + " ".join(f"WHEN {which} = '{c}' THEN {any_of('text', *t)}" for c, t in VECTOR_TERMS.items()) + " END"


CLASSIFIED = f"""{CENTROIDS},
    docs AS (
        SELECT d.doc_id, d.text, CAST(e.label AS VARCHAR) AS label, CAST(e.embedding AS DOUBLE[]) AS v
        FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
    scored AS (
        SELECT d.doc_id, c.class, CAST(c.class AS INTEGER) AS ordinal, list_dot_product(d.v, c.centroid) AS score
        FROM docs d CROSS JOIN centroids c WHERE {strip('d.text')} <> ''),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ordinal) AS place FROM scored),
    pairs AS (
        SELECT a.doc_id, a.class AS c1, a.ordinal AS o1, a.score AS s1, b.class AS c2, b.ordinal AS o2, b.score AS s2
        FROM placed a JOIN placed b USING (doc_id) WHERE a.place = 1 AND b.place = 2),
    hits AS (
        SELECT p.*, {vector_hit('p.c1')} AS h1, {vector_hit('p.c2')} AS h2
        FROM pairs p JOIN docs USING (doc_id)),
    raised AS (SELECT *, CASE WHEN h1 THEN least(1.0, s1 + 0.08) ELSE s1 END AS own FROM hits),
    overtaken AS (
        SELECT *, h2 AND (CASE WHEN o1 < o2 THEN own ELSE s1 END) < 0.20 AS swap FROM raised),
    boosted AS (
        SELECT doc_id, CASE WHEN swap THEN c2 ELSE c1 END AS class,
               CASE WHEN swap THEN least(1.0, s2 + 0.12) ELSE own END AS score,
               s1 - s2 AS margin, swap OR h1 AS boosted
        FROM overtaken),
    classified AS (
        SELECT d.doc_id, d.text, d.label, d.v, coalesce(b.class, '9') AS class,
               coalesce(round_even(b.score, 4), 0.0) AS confidence,
               coalesce(round_even(b.margin, 4), 0.0) AS margin,
               coalesce(b.score < 0.20 OR (b.margin < 0.04 AND b.score < 0.60), true) AS needs_fallback,
               b.boosted AS keyword_boosted
        FROM docs d LEFT JOIN boosted b USING (doc_id))"""


def corpus() -> str:
    return f"""
    corpus AS (
        SELECT doc_id AS thread_id, text AS reply, class, {like('text', BOILERPLATE)} AS is_boilerplate, v
        FROM classified WHERE length(text) >= 12)"""


def retrieved(source: str) -> str:
    """Candidates, re-ranked top three and per-query summary for ``source(doc_id, class, v)``."""
    return f"""{corpus()},
    sims AS (
        SELECT q.doc_id, c.thread_id, c.class, c.is_boilerplate, q.class AS predicted,
               list_dot_product(q.v, c.v) AS similarity
        FROM {source} q JOIN corpus c ON c.thread_id <> q.doc_id),
    pool AS (
        SELECT * FROM sims
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round_even(similarity, 9) DESC, thread_id) <= 30),
    adjusted AS (
        SELECT *, round_even(
            CASE WHEN is_boilerplate
                 THEN similarity + (CASE WHEN class = predicted AND predicted <> '9' THEN 0.05 ELSE 0.0 END) - 0.03
                 ELSE similarity + (CASE WHEN class = predicted AND predicted <> '9' THEN 0.05 ELSE 0.0 END) END, 4) AS ranking_score,
            round_even(similarity, 4) AS raw_similarity
        FROM pool),
    top AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ranking_score DESC, round_even(similarity, 9) DESC, thread_id) AS rank
        FROM adjusted QUALIFY rank <= 3),
    best AS (
        SELECT doc_id, round_even(max(raw_similarity), 4) AS best_similarity,
               round_even(sum(raw_similarity ORDER BY rank) / count(*), 4) AS mean_similarity,
               string_agg(CAST(thread_id AS VARCHAR), ',' ORDER BY rank) AS grounding_ids, count(*) AS matches_count,
               arg_min(thread_id, rank) AS first_id
        FROM top GROUP BY doc_id)"""


def per_class(source: str, by: str = "") -> str:
    """``stats(by, class, tp, fp, fn, support, p, r, f1)`` from ``source(by, truth, predicted)``."""
    group = f"{by}, " if by else ""
    return f"""
    tallies AS (
        SELECT {group}truth AS class, CAST(truth = predicted AS INT) AS tp, 0 AS fp, CAST(truth <> predicted AS INT) AS fn FROM {source}
        UNION ALL
        SELECT {group}predicted, 0, 1, 0 FROM {source} WHERE truth <> predicted),
    sums AS (
        SELECT {group}class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM tallies GROUP BY {group}class),
    stats AS (
        SELECT *, tp + fn AS support, {share('tp', 'tp + fp')} AS p, {share('tp', 'tp + fn')} AS r,
               {share('2 * tp', '2 * tp + fp + fn')} AS f1 FROM sums)"""


SUMMARY = f"""CAST(sum(support) AS BIGINT) AS total_cases,
    round_even({share('sum(tp)', 'sum(support)')}, 4) AS accuracy, round_even(avg(f1), 4) AS macro_f1,
    round_even(avg(p), 4) AS macro_precision, round_even(avg(r), 4) AS macro_recall,
    round_even({share('sum(f1 * support)', 'sum(support)')}, 4) AS weighted_f1"""


def routing(truth: str, predicted: str) -> str:
    def cell(t: str, p: str) -> str:
        return f"count(*) FILTER (WHERE {truth} = '{t}' AND {predicted} = '{p}')"

    return f"""{cell('escalate', 'escalate')} AS tp, {cell('auto_handle', 'auto_handle')} AS tn,
        {cell('auto_handle', 'escalate')} AS fp, {cell('escalate', 'auto_handle')} AS fn"""


def rates(prefix: str = "") -> str:
    p, r = share("tp", "tp + fp"), share("tp", "tp + fn")
    return f"""tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives,
        round_even({p}, 4) AS {prefix}precision, round_even({r}, 4) AS {prefix}recall,
        round_even({share('tn', 'tn + fp')}, 4) AS {prefix}specificity,
        round_even({share(f'2 * {p} * {r}', f'{p} + {r}')}, 4) AS {prefix}f1,
        round_even({share('fn', 'tp + fn')}, 4) AS false_autohandle_rate,
        round_even({share('fp', 'tn + fp')}, 4) AS false_escalate_rate"""


def rubric(reply: str, applicable: str, contact: list[str], empathy: list[str], money: str) -> str:
    """Select list of the rubric scores."""
    m = f"(contains({reply}, '$') OR contains(lower({reply}), '{money}'))"
    short = f"length({reply}) < 30"
    c, e = any_of(reply, *contact), any_of(reply, *empathy)

    def score(generic: float, base: str, bonus: str | None) -> str:
        value = f"least(5.0, {base} + CASE WHEN {bonus} THEN 0.5 ELSE 0.0 END)" if bonus else base
        return f"CASE WHEN {applicable} THEN CASE WHEN {reply} = '{GENERIC}' THEN {generic} ELSE CAST({value} AS DOUBLE) END END"

    return f"""{score(2.5, f'(4.0 - CASE WHEN {m} THEN 2.0 ELSE 0.0 END)', None)} AS groundedness,
        {score(3.0, f'(4.0 - CASE WHEN {m} THEN 1.5 ELSE 0.0 END)', c)} AS correctness,
        {score(3.0, f'(4.0 - CASE WHEN {short} THEN 1.0 ELSE 0.0 END)', e)} AS tone_empathy,
        {score(2.5, f'(4.0 - CASE WHEN {short} THEN 1.5 ELSE 0.0 END)', c)} AS completeness"""


TRIAGED = f"""{CLASSIFIED},
        messages AS (
            SELECT d.doc_id, {strip('d.text')} AS message, coalesce(c.class, '9') AS class, coalesce(c.confidence, 0.0) AS confidence, c.v,
                   CASE WHEN {like('d.text', '[a-z0-9._]+@[a-z0-9.]+[.]com')} THEN 1 WHEN {like('d.text', 'licen[sc]e|copyright')} THEN 2
                        WHEN {like('d.text', word('nicht|pas|kein'))} THEN 3 WHEN {like('d.text', '[0-9]{6,}')} THEN 4 END AS rule
            FROM documents d LEFT JOIN classified c USING (doc_id)),
        asked AS (SELECT * FROM messages WHERE rule IS NULL AND v IS NOT NULL),
        {retrieved('asked').strip()},
        routed AS (
            SELECT m.*, coalesce(b.best_similarity, 0.0) AS similarity, coalesce(b.grounding_ids, '') AS ids,
                   coalesce(b.matches_count, 0) AS n, f.reply AS first_reply, f.is_boilerplate AS first_boilerplate,
                   CASE WHEN rule IS NOT NULL THEN CASE rule WHEN 1 THEN 'contact_data' WHEN 2 THEN 'license' WHEN 3 THEN 'negation' ELSE 'long_number' END
                        WHEN confidence < 0.20 THEN 'low_intent_confidence'
                        WHEN coalesce(b.best_similarity, 0.0) < 0.36 THEN 'no_similar_precedent'
                        WHEN m.class = '8' AND {like('message', word('the|and'))} THEN 'policy_refund_agent_only'
                        WHEN m.class = '9' AND coalesce(b.best_similarity, 0.0) < 0.40 THEN 'ambiguous_intent' ELSE 'ok' END AS reason_code
            FROM messages m LEFT JOIN best b USING (doc_id) LEFT JOIN corpus f ON f.thread_id = b.first_id),
    triaged AS (
        SELECT doc_id, class, confidence, CASE reason_code WHEN 'ok' THEN 'auto_handle' ELSE 'escalate' END AS decision, reason_code,
               similarity AS best_similarity, ids AS grounding_ids,
               CASE WHEN rule IS NOT NULL THEN 'A member of our team has to look at this one and will get back to you.'
                    WHEN length(first_reply) > 25 AND NOT first_boilerplate THEN first_reply
                    WHEN class = '0' THEN 'Template of class 0' ELSE '{GENERIC}' END AS draft_reply,
               CASE WHEN rule IS NOT NULL THEN 'hard_rules' ELSE 'heuristic_model' END AS layer,
               CASE rule WHEN 1 THEN 'An e-mail address' WHEN 2 THEN 'A license line' WHEN 3 THEN 'A negated sentence'
                         WHEN 4 THEN 'A long number' END AS rule_description,
               CASE WHEN rule IS NULL THEN n END AS matches_count FROM routed)"""

OVERALL = "round_even((groundedness + correctness + tone_empathy + completeness) / 4.0, 2)"
DIMENSIONS = ["groundedness", "correctness", "tone_empathy", "completeness", "overall"]

AGENT_CLASS = "CASE CAST(t.class AS INTEGER) % 4 WHEN 0 THEN 'english' WHEN 1 THEN 'french' WHEN 2 THEN 'german' ELSE 'spanish' END"

PREDICTIONS = f"""{TRIAGED},
    examples AS (
        SELECT d.doc_id, d.text, d.n_chars,
               CASE d.lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' WHEN 'es' THEN 'spanish' END AS truth,
               CASE WHEN l.toxic = 1 THEN 'escalate' ELSE 'auto_handle' END AS gold_decision, l.quality = 0 AS adversarial
        FROM documents d JOIN labels l USING (doc_id)),
    answers AS (
        SELECT 'constant' AS system, examples.*, 'other' AS predicted, 'auto_handle' AS decision, '{GENERIC}' AS reply FROM examples
        UNION ALL
        SELECT 'keyword', examples.*, {language('text')},
               CASE WHEN {like('text', ESCALATE)} THEN 'escalate' ELSE 'auto_handle' END, {template('(' + language('text') + ')')} FROM examples
        UNION ALL
        SELECT 'length', examples.*, CASE WHEN n_chars > 1000 THEN 'english' ELSE 'german' END,
               CASE WHEN n_chars < 800 THEN 'escalate' ELSE 'auto_handle' END, text FROM examples
        UNION ALL
        SELECT 'agent', examples.*, {AGENT_CLASS}, t.decision, t.draft_reply FROM examples JOIN triaged t USING (doc_id)),
    judged AS (
        SELECT *, {rubric('reply', "decision <> 'escalate'", ['dm', 'record locator', 'confirmation'],
                          ['sorry', 'apologize', 'understand', 'glad', 'happy to help'], 'dollar')} FROM answers),
    all_rows AS (SELECT *, {OVERALL} AS overall FROM judged),
    sliced AS (
        SELECT *, 'overall' AS slice FROM all_rows
        UNION ALL SELECT *, CASE WHEN adversarial THEN 'adversarial' ELSE 'natural_heldout' END FROM all_rows),
    {per_class('sliced', 'system, slice').strip()},
    labels_part AS (SELECT system, slice, {SUMMARY} FROM stats GROUP BY system, slice),
    routes AS (SELECT system, slice, {routing('gold_decision', 'decision')} FROM sliced GROUP BY system, slice),
    routes_part AS (SELECT system, slice, {rates('escalation_')} FROM routes),
    judge_part AS (
        SELECT system, slice, count(overall) AS n_evaluated_replies, count(*) AS judged_cases,
               {', '.join(f"round_even({share(f'sum({d})', 'count(overall)')}, 2) AS avg_{d}" for d in DIMENSIONS)},
               round_even({share('count(overall)', 'count(*)')} * 100, 1) AS autohandle_pct,
               'Deterministic Offline Heuristic Rubric' AS judge_label
        FROM sliced GROUP BY system, slice),
    results AS (
        SELECT * FROM labels_part JOIN routes_part USING (system, slice) JOIN judge_part USING (system, slice))"""

JUDGED = f"""WITH rows AS (
            SELECT d.doc_id, d.text AS reply, CASE WHEN d.n_chars < 800 THEN 'escalate' ELSE 'auto_handle' END AS decision, quality, toxic
            FROM documents d JOIN labels USING (doc_id)),
        ruled AS (
            SELECT *, decision <> 'escalate' AS is_applicable, decision <> 'escalate' AND toxic = 0 AS answered,
                   {rubric('reply', "decision <> 'escalate'", ['dm', 'record locator', 'confirmation'],
                           ['sorry', 'apologize', 'understand', 'glad', 'happy to help'], 'dollar')} FROM rows),
        scored AS (
            SELECT doc_id, toxic, is_applicable, answered, CASE WHEN answered THEN quality + 4.0::DOUBLE ELSE groundedness END AS groundedness,
                   CASE WHEN answered THEN 5.0::DOUBLE ELSE correctness END AS correctness,
                   CASE WHEN answered THEN 3.5::DOUBLE ELSE tone_empathy END AS tone_empathy,
                   CASE WHEN answered THEN 5.0::DOUBLE - quality ELSE completeness END AS completeness FROM ruled)"""

PROMPTS = """
    prompts AS (
        SELECT doc_id, text, 'Customer message: "' || text || '"' || chr(10) || 'Class:' AS prompt FROM documents),
    keyed AS (
        SELECT *, sha256('offline:Answer with one class name.' || chr(10) || chr(10) || prompt) AS cache_key FROM prompts)"""

ANSWERS = f"""{PROMPTS},
    stored AS (
        SELECT cache_key, min(' ''' || upper({language('text', 'none of them')}) || ''' ') AS response
        FROM keyed JOIN labels USING (doc_id) GROUP BY cache_key),
    found AS (SELECT k.*, coalesce(s.response, '') AS response FROM keyed k LEFT JOIN stored s USING (cache_key))"""

def agreement_sql() -> str:
    pairs = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST(round_even(j.{d}, 0) AS BIGINT) AS j, CAST(round_even(h.{d}, 0) AS BIGINT) AS h "
        "FROM judge j JOIN human h USING (example_id) WHERE j.is_applicable"
        for d in DIMENSIONS
    )
    return f"""WITH
    judge AS (
        SELECT doc_id AS example_id, n_chars > 100 AS is_applicable,
               1.0 + least(floor(n_chars / 400.0), 8) / 2.0 AS groundedness,
               CASE WHEN lang <> 'es' THEN CAST(4.5 AS DOUBLE) END AS correctness, CAST(4.0 AS DOUBLE) AS tone_empathy,
               CAST(CASE WHEN n_chars > 1000 THEN 5.0 WHEN n_chars > 300 THEN 4.0 ELSE 2.0 END AS DOUBLE) AS completeness,
               CAST(3.5 AS DOUBLE) AS overall
        FROM documents),
    human AS (
        SELECT doc_id AS example_id, CAST(quality * 2 + toxic + 2 AS DOUBLE) AS groundedness,
               CAST(quality + 3 AS DOUBLE) AS correctness, CAST(4.0 AS DOUBLE) AS tone_empathy,
               CAST(quality * 2.5 + 2 AS DOUBLE) AS completeness, CAST(toxic * 1.5 + 2.5 AS DOUBLE) AS overall
        FROM labels),
    pairs AS (SELECT * FROM ({pairs}) WHERE j IS NOT NULL AND h IS NOT NULL),
    seen AS (SELECT dimension, j AS value FROM pairs UNION SELECT dimension, h FROM pairs),
    ranks AS (SELECT dimension, value, row_number() OVER (PARTITION BY dimension ORDER BY value) AS rank FROM seen),
    ranked AS (
        SELECT p.*, a.rank AS rj, b.rank AS rh FROM pairs p
        JOIN ranks a ON a.dimension = p.dimension AND a.value = p.j
        JOIN ranks b ON b.dimension = p.dimension AND b.value = p.h),
    expected AS (
        SELECT x.dimension, sum((x.rj - y.rh) * (x.rj - y.rh) * x.n * y.n) AS weighted
        FROM (SELECT dimension, rj, count(*) AS n FROM ranked GROUP BY ALL) x
        JOIN (SELECT dimension, rh, count(*) AS n FROM ranked GROUP BY ALL) y USING (dimension) GROUP BY x.dimension),
    observed AS (
        SELECT dimension, count(*) AS n, sum((rj - rh) * (rj - rh)) AS weighted,
               avg(CAST(j = h AS DOUBLE)) AS exact, avg(CAST(abs(j - h) <= 1 AS DOUBLE)) AS near,
               min(j) = max(j) AND min(h) = max(h) AS fixed, min(j) = min(h) AS equal,
               CASE WHEN min(j) = max(j) OR min(h) = max(h) THEN 0.0
                    ELSE covar_pop(j, h) / (stddev_pop(j) * stddev_pop(h)) END AS r
        FROM ranked GROUP BY dimension)
    SELECT dimension,
           round_even(CASE WHEN fixed THEN CASE WHEN equal THEN 1.0 ELSE 0.0 END
                           ELSE 1.0 - CAST(o.weighted AS DOUBLE) * n / CAST(e.weighted AS DOUBLE) END, 4) AS cohen_kappa_quadratic,
           round_even(exact * 100, 2) AS exact_match_pct, round_even(near * 100, 2) AS within_plus_minus_one_pct,
           round_even(r, 4) AS pearson_correlation, n AS sample_size
    FROM observed o JOIN expected e USING (dimension)"""


COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


def audit(table: str, columns: list[str]) -> str:
    nulls = " + ".join(f"(count(*) - count({c}))" for c in columns)
    return (
        f"SELECT '{table}' AS table_name, count(*) AS rows, CAST({len(columns)} AS BIGINT) AS columns, "
        f"{nulls} AS null_cells FROM {table}"
    )


CANDIDATES = """
    SELECT a.vec_id, b.vec_id AS neighbour,
           list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"""

ORACLES: dict[str, str] = {
    "scan_filter": "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'fr'",
    "text_clean": f"""SELECT doc_id, {clean('text')} AS cleaned, sha256(lower({strip('text')})) AS text_digest,
        CAST({word_count('text')} AS BIGINT) AS words, length({strip('text')}) BETWEEN 20 AND 300 AS in_band FROM documents""",
    "boilerplate_flag": f"SELECT doc_id, {like('text', BOILERPLATE)} AS is_boilerplate FROM documents",
    "rule_first_match": rf"""
        WITH matched AS (
            SELECT doc_id, CASE WHEN {like('text', '[a-z0-9._]+@[a-z0-9.]+[.]com')} THEN 1
                        WHEN {like('text', 'licen[sc]e|copyright')} THEN 2
                        WHEN {like('text', word('nicht|pas|kein'))} THEN 3
                        WHEN {like('text', '[0-9]{6,}')} THEN 4 END AS rule FROM documents)
        SELECT doc_id, CASE rule WHEN 1 THEN 'contact_data' WHEN 2 THEN 'license' WHEN 3 THEN 'negation' WHEN 4 THEN 'long_number' END AS code,
               CASE rule WHEN 1 THEN 'An e-mail address' WHEN 2 THEN 'A license line' WHEN 3 THEN 'A negated sentence'
                         WHEN 4 THEN 'A long number' END AS description FROM matched""",
    "keyword_hits": f"""SELECT doc_id, concat_ws(',',
            CASE WHEN {any_of('text', 'eaux', 'mente', 'queai')} THEN 'french' END,
            CASE WHEN {any_of('text', 'ung', 'keit', 'nicht')} THEN 'german' END,
            CASE WHEN {any_of('text', 'los', 'ñ', 'ción')} THEN 'spanish' END,
            CASE WHEN {any_of('text', 'thing', 'tion', 'sue')} THEN 'english' END) AS classes FROM documents""",
    "keyword_baseline": f"""
        WITH k AS (SELECT doc_id, {language('text')} AS class, {like('text', ESCALATE)} AS hit FROM documents)
        SELECT doc_id, class, CASE WHEN class <> 'other' THEN CAST(0.70 AS DOUBLE) ELSE CAST(0.40 AS DOUBLE) END AS confidence,
               CASE WHEN hit THEN 'escalate' ELSE 'auto_handle' END AS decision,
               CASE WHEN hit THEN 'rule_keyword_escalation' ELSE 'rule_keyword_autohandle' END AS reason_code,
               CAST(0.0 AS DOUBLE) AS best_similarity, {template('class')} AS draft_reply, 'keyword' AS system FROM k
        UNION ALL
        SELECT doc_id, 'other', 0.5, 'auto_handle', 'trivial_always_autohandle', 0.0, '{GENERIC}', 'constant' FROM documents""",
    "label_ladder": f"""
        WITH c AS (SELECT doc_id, text, {language('text')} AS class, CASE WHEN length(text) > 500 THEN 0.7 ELSE 0.3 END AS confidence FROM documents)
        SELECT doc_id, class, {label('text', 'class', 'confidence', 'decision')} AS decision,
               {label('text', 'class', 'confidence', 'reason')} AS reason FROM c""",
    "distribution": """SELECT lang, source, count(*) AS n, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct
        FROM documents GROUP BY lang, source""",
    "thread_extract": f"WITH {THREADS} SELECT * FROM threads",
    "thread_profile": f"""WITH {THREADS}
        SELECT count(*) AS threads, round_even(avg(turns_count), 6) AS avg_turns, max(turns_count) AS max_turns,
               count(*) FILTER (WHERE is_boilerplate) AS boilerplate_replies,
               round_even(avg(CAST(is_boilerplate AS DOUBLE)) * 100.0, 6) AS boilerplate_pct,
               round_even(avg({word_count('customer_message')}), 6) AS avg_customer_words,
               round_even(avg({word_count('agent_reply')}), 6) AS avg_reply_words FROM threads""",
    "parse_turns": f"""WITH {PARSED}
        SELECT block_id, row_number() OVER (PARTITION BY block_id ORDER BY segment) - 1 AS position, role, body AS text FROM parsed""",
    "thread_extract_blocks": f"""WITH {PARSED},
        sides AS (
            SELECT block_id AS thread_id, arg_min(body, segment) FILTER (WHERE role = 'customer') AS customer_message,
                   arg_min(body, segment) FILTER (WHERE role = 'support') AS agent_reply, count(*) AS turns_count,
                   count(*) FILTER (WHERE role = 'customer') AS num_customer_turns,
                   count(*) FILTER (WHERE role = 'support') AS num_support_turns,
                   string_agg(role || '=' || body, '|' ORDER BY segment) AS raw_turns
            FROM parsed GROUP BY block_id)
        SELECT *, {like('agent_reply', BOILERPLATE)} AS is_boilerplate FROM sides
        WHERE length(customer_message) >= 8 AND length(agent_reply) >= 8""",
    "reply_pairs": f"""
        WITH pairs AS (
            SELECT 'tw_' || CAST(c.conv_id AS VARCHAR) || ':' || CAST(c.turn AS VARCHAR) AS thread_id,
                   {clean('c.text')} AS customer_message, {clean('r.text')} AS agent_reply
            FROM conversations c JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1
            WHERE r.role = 'assistant')
        SELECT thread_id, customer_message, agent_reply, CAST(2 AS BIGINT) AS turns_count, CAST(1 AS BIGINT) AS num_customer_turns,
               CAST(1 AS BIGINT) AS num_support_turns, {like('agent_reply', BOILERPLATE)} AS is_boilerplate
        FROM pairs WHERE length(customer_message) >= 8 AND length(agent_reply) >= 8""",
    "answered_messages": """
        SELECT CAST(c.conv_id AS VARCHAR) || ':' || CAST(c.turn AS VARCHAR) AS tweet_id, c.role AS author_id
        FROM conversations c SEMI JOIN (SELECT * FROM conversations WHERE role = 'assistant') r
          ON r.conv_id = c.conv_id AND r.turn = c.turn + 1""",
    "sample_n": f"SELECT doc_id, lang, n_chars FROM documents ORDER BY {key('doc_id')}, doc_id LIMIT 100",
    "shuffle_order": f"""
        WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {key('doc_id')}, doc_id) AS shuffle_rank FROM documents)
        SELECT *, format('gold-{{:03d}}', shuffle_rank + 24) AS example_id FROM r""",
    "dedup_first": f"""SELECT doc_id, lang FROM documents
        QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY {key('doc_id')}, doc_id) = 1""",
    "quota_sample": f"""SELECT doc_id, lang, n_chars FROM documents
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {key('doc_id')}, doc_id)
            <= CASE lang WHEN 'en' THEN 50 WHEN 'fr' THEN 40 WHEN 'de' THEN 30 WHEN 'es' THEN 500 ELSE 0 END""",
    "holdout_anti": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "used_text_anti": f"""
        WITH used AS (SELECT DISTINCT lower({strip('text')}) AS k FROM documents JOIN labels USING (doc_id))
        SELECT doc_id, lang FROM documents d ANTI JOIN used ON used.k = lower({strip('d.text')})""",
    "leakage_audit": f"""
        WITH corpus AS (SELECT doc_id, lower({strip('text')}) AS k FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id),
        evaluation AS (SELECT doc_id, lower({strip('text')}) AS k FROM documents JOIN labels USING (doc_id)),
        seeds AS (SELECT lower({strip('text')}) AS k FROM benchmark)
        SELECT 'corpus_evaluation_ids' AS "check", (SELECT count(*) FROM (SELECT doc_id FROM corpus INTERSECT SELECT doc_id FROM evaluation)) AS shared
        UNION ALL SELECT 'corpus_evaluation_texts', (SELECT count(*) FROM (SELECT k FROM corpus INTERSECT SELECT k FROM evaluation))
        UNION ALL SELECT 'evaluation_seed_texts', (SELECT count(*) FROM (SELECT k FROM evaluation INTERSECT SELECT k FROM seeds))""",
    "shared_texts": f"""
        WITH a AS (SELECT sha256(lower({strip('text')})) AS digest, count(*) AS rows_a
                   FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1),
        b AS (SELECT sha256(lower({strip('text')})) AS digest, count(*) AS rows_b FROM documents JOIN labels USING (doc_id) GROUP BY 1)
        SELECT * FROM a JOIN b USING (digest)""",
    "labelled_set": f"""
        WITH pool AS (
            SELECT doc_id, {strip('text')} AS message, {language('text')} AS class,
                   CASE WHEN length(text) > 500 THEN 0.7 ELSE 0.3 END AS confidence
            FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id),
        band AS (SELECT * FROM pool WHERE length(message) BETWEEN 20 AND 3000),
        unused AS (SELECT b.* FROM band b ANTI JOIN (SELECT lower({strip('text')}) AS k FROM benchmark) u ON u.k = lower({strip('b.message')})),
        firsts AS (SELECT * FROM unused QUALIFY row_number() OVER (PARTITION BY lower(message) ORDER BY {key('doc_id')}, doc_id) = 1),
        drawn AS (
            SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY class ORDER BY {key('doc_id')}, doc_id)
                <= CASE class WHEN 'french' THEN 12 WHEN 'german' THEN 9 WHEN 'spanish' THEN 20 WHEN 'english' THEN 40 ELSE 5 END),
        ranked AS (SELECT *, row_number() OVER (ORDER BY {key('doc_id')}, doc_id) + (SELECT count(*) FROM benchmark) AS n FROM drawn)
        SELECT format('gold-{{:03d}}', item_id + 1) AS example_id, format('adv_{{:03d}}', item_id + 1) AS thread_id, text AS customer_message,
               'english' AS gold_class, 'escalate' AS gold_decision, 'fixed' AS gold_reason, '' AS must_contain, true AS is_adversarial,
               'benchmark' AS adversarial_type, 'Human-Author' AS annotator FROM benchmark
        UNION ALL
        SELECT format('gold-{{:03d}}', n), CAST(doc_id AS VARCHAR), message, class, {label('message', 'class', 'confidence', 'decision')},
               {label('message', 'class', 'confidence', 'reason')},
               CASE class WHEN 'french' THEN 'Must answer in French' WHEN 'german' THEN 'Must answer in German' ELSE 'Must ask for details' END,
               false, NULL, 'Human-Author' FROM ranked""",
    "table_audit": " UNION ALL ".join(audit(t, c.split()) for t, c in COLUMNS.items()),
    "centroids": f"""WITH {CENTROIDS}
        SELECT m.class, m.position, round_even(m.value / n.size, 6) AS value FROM means m JOIN norms n USING (class)""",
    "class_scores": f"""WITH {CENTROIDS}
        SELECT vec_id, class, round_even(list_dot_product(CAST(embedding AS DOUBLE[]), centroid), 6) AS score
        FROM embeddings CROSS JOIN centroids""",
    "nearest_centroid": f"WITH {CLASSIFIED} SELECT doc_id, class, confidence, margin, needs_fallback, keyword_boosted FROM classified",
    "corpus_build": f"""WITH {CLASSIFIED}, {corpus()}
        SELECT thread_id, class, is_boilerplate, length(reply) AS reply_chars, len(v) AS dimensions FROM corpus""",
    "knn_candidates": f"""
        WITH sims AS ({CANDIDATES}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round_even(similarity, 9) DESC, neighbour) AS rank FROM sims QUALIFY rank <= 30)
        SELECT vec_id, rank, neighbour, round_even(similarity, 6) AS similarity FROM ranked""",
    "rerank_topk": f"""WITH {CLASSIFIED}, {retrieved('classified')}
        SELECT doc_id, rank, thread_id AS match_id, raw_similarity, ranking_score, best_similarity, mean_similarity
        FROM top JOIN best USING (doc_id)""",
    "precedent_prompt": f"""WITH {CLASSIFIED}, {retrieved('classified')},
        snippets AS (
            SELECT t.doc_id, string_agg('Precedent ' || rank || ': "' || c.reply || '"', chr(10) ORDER BY rank) AS lines
            FROM top t JOIN corpus c USING (thread_id) GROUP BY t.doc_id),
        prompts AS (
            SELECT q.doc_id, 'Class: ' || q.class || chr(10) || 'Message: "' || q.text || '"' || chr(10) || chr(10) || 'Precedents:'
                   || chr(10) || coalesce(s.lines, '') || chr(10) || chr(10) || 'Reply:' AS prompt
            FROM classified q LEFT JOIN snippets s USING (doc_id))
        SELECT doc_id, length(prompt) AS prompt_chars,
               sha256('offline:Answer with one class name.' || chr(10) || chr(10) || prompt) AS cache_key FROM prompts""",
    "triage_messages": f"WITH {TRIAGED} SELECT * FROM triaged",
    "response_lookup": f"WITH {ANSWERS} SELECT doc_id, cache_key, trim({strip('response')}, '\"') AS response FROM found",
    "pending_prompts": f"""WITH {PROMPTS},
        answered AS (SELECT cache_key FROM keyed JOIN labels USING (doc_id))
        SELECT cache_key, min(prompt) AS prompt, count(*) AS requests FROM keyed k
        ANTI JOIN answered a ON a.cache_key = k.cache_key GROUP BY cache_key""",
    "class_override": f"""WITH {ANSWERS},
        decided AS (
            SELECT *, replace(replace(lower({strip('response')}), '"', ''), '''', '') AS answer,
                   CASE WHEN length(text) > 1500 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS before FROM found),
        tested AS (
            SELECT *, length(text) < 3000 AND answer IN ('french', 'german', 'spanish', 'english', 'other') AS verified FROM decided)
        SELECT doc_id, CASE WHEN verified THEN answer ELSE 'other' END AS class,
               CASE WHEN verified THEN greatest(before, 0.75) ELSE before END AS confidence, verified FROM tested""",
    "class_report": f"""WITH {CLASSIFIED},
        outcome AS (SELECT label AS truth, class AS predicted FROM classified), {per_class('outcome').strip()},
        taxonomy AS (SELECT unnest(['0', '1', '2', '3', '4', '5', '6', '7', '8', '9', 'never']) AS class)
        SELECT class, round_even(coalesce(p, 0.0), 4) AS precision, round_even(coalesce(r, 0.0), 4) AS recall,
               round_even(coalesce(f1, 0.0), 4) AS f1, CAST(coalesce(support, 0) AS BIGINT) AS support
        FROM taxonomy LEFT JOIN stats USING (class)""",
    "class_summary": f"""WITH {CLASSIFIED},
        outcome AS (SELECT label AS truth, class AS predicted FROM classified), {per_class('outcome').strip()}
        SELECT {SUMMARY} FROM stats""",
    "escalation_report": f"""
        WITH rows AS (
            SELECT lang, CASE WHEN quality = 0 THEN 'escalate' ELSE 'auto_handle' END AS gold,
                   CASE WHEN n_chars < 1500 THEN 'escalate' ELSE 'auto_handle' END AS decision
            FROM documents JOIN labels USING (doc_id)),
        cells AS (SELECT lang, count(*) AS total, {routing('gold', 'decision')} FROM rows GROUP BY lang)
        SELECT lang, total, {rates()} FROM cells""",
    "benchmark_slices": f"WITH {PREDICTIONS} SELECT * FROM results",
    "benchmark_table": f"""WITH {PREDICTIONS}
        SELECT o.system AS "System", o.accuracy AS "Intent_Acc_Overall", n.accuracy AS "Intent_Acc_Natural",
               a.accuracy AS "Intent_Acc_Adversarial", o.macro_f1 AS "Intent_MacroF1_Overall",
               o.escalation_precision AS "Escalation_Precision", o.escalation_recall AS "Escalation_Recall",
               o.false_negatives AS "Costly_False_AutoHandles", o.false_autohandle_rate AS "Costly_False_AutoHandle_Rate",
               o.false_positives AS "Unnecessary_False_Escalates", o.false_escalate_rate AS "Unnecessary_False_Escalate_Rate",
               CAST(o.n_evaluated_replies AS VARCHAR) || '/' || CAST(o.judged_cases AS VARCHAR) AS "AutoHandled_Replies_Evaluated",
               o.avg_groundedness AS "Avg_Groundedness", o.avg_correctness AS "Avg_Correctness", o.avg_tone_empathy AS "Avg_Tone_Empathy",
               o.avg_completeness AS "Avg_Completeness", o.avg_overall AS "Avg_Overall_Quality"
        FROM results o JOIN results n ON n.system = o.system AND n.slice = 'natural_heldout'
        JOIN results a ON a.system = o.system AND a.slice = 'adversarial' WHERE o.slice = 'overall'""",
    "rubric": f"""
        WITH s AS (SELECT conv_id, turn, role = 'assistant' AS is_applicable,
                   {rubric('text', "role = 'assistant'", ['nicht', 'thing'], ['les', 'hand', 'und'], 'tion')} FROM conversations)
        SELECT *, {OVERALL} AS overall, CASE WHEN is_applicable THEN 'heuristic' END AS judge_type FROM s""",
    "rubric_summary": f"""
        WITH s AS (SELECT role, {rubric('text', "role = 'assistant'", ['nicht', 'thing'], ['les', 'hand', 'und'], 'tion')} FROM conversations),
        o AS (SELECT *, {OVERALL} AS overall FROM s)
        SELECT role, count(overall) AS n_evaluated_replies, count(*) AS judged_cases,
               {', '.join(f"round_even({share(f'sum({d})', 'count(overall)')}, 2) AS avg_{d}" for d in DIMENSIONS)},
               round_even({share('count(overall)', 'count(*)')} * 100, 1) AS autohandle_pct,
               'Deterministic Offline Heuristic Rubric' AS judge_label FROM o GROUP BY role""",
    "audit_join": """
        SELECT doc_id AS example_id, lang, quality * 2 + 3 AS groundedness, toxic + 4 AS correctness, 5 - quality AS tone_empathy,
               quality + toxic + 2 AS completeness,
               round_even(CAST(quality * 2 + 3 + toxic + 4 + 5 - quality + quality + toxic + 2 AS DOUBLE) / 4.0, 2) AS overall
        FROM documents JOIN labels USING (doc_id)""",
    "agreement": agreement_sql(),
    "silhouette": """
        WITH points AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        sums AS (
            SELECT a.vec_id, a.label, b.label AS other, count(*) AS members,
                   sum(CASE WHEN a.vec_id = b.vec_id THEN 0.0 ELSE pow(list_distance(a.v, b.v), 2) END) AS total
            FROM points a CROSS JOIN points b GROUP BY ALL),
        per_point AS (
            SELECT vec_id, max(members) FILTER (WHERE other = label) AS own,
                   max(total / nullif(members - 1, 0)) FILTER (WHERE other = label) AS a,
                   min(total / members) FILTER (WHERE other <> label) AS b
            FROM sums GROUP BY vec_id)
        SELECT count(*) AS points, round_even(avg(CASE WHEN own > 1 THEN coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) ELSE 0.0 END), 6) AS silhouette
        FROM per_point""",
    "kmeans_step": f"""WITH {CENTROIDS},
        near AS (
            SELECT vec_id, class, pow(list_distance(CAST(embedding AS DOUBLE[]), centroid), 2) AS d FROM embeddings CROSS JOIN centroids
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, CAST(class AS INTEGER)) = 1)
        SELECT class AS cluster, count(*) AS members, round_even(sum(d), 6) AS cost FROM near GROUP BY class""",
    "knn_cells": f"""
        WITH sims AS ({CANDIDATES}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round_even(similarity, 9) DESC, neighbour) AS rank FROM sims QUALIFY rank <= 10)
        SELECT vec_id, rank, neighbour, round_even(similarity, 6) AS similarity FROM ranked""",
    "shared_thread_replies": f"""WITH {CLASSIFIED},
        corpus AS (
            SELECT doc_id // 3 AS thread_id, doc_id || ': ' || text AS reply, class, {like('text', BOILERPLATE)} AS is_boilerplate, v,
                   md5((doc_id // 3) || chr(1) || text || chr(1) || doc_id || ': ' || text) AS k
            FROM classified WHERE length(text) >= 12),
        sims AS (
            SELECT q.doc_id, c.*, q.class AS predicted, list_dot_product(q.v, c.v) AS similarity FROM classified q CROSS JOIN corpus c),
        pool AS (
            SELECT * FROM sims
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round_even(similarity, 9) DESC, thread_id, k) <= 30),
        adjusted AS (
            SELECT *, round_even(similarity + (CASE WHEN class = predicted AND predicted <> '9' THEN 0.05 ELSE 0.0 END)
                                 - (CASE WHEN is_boilerplate THEN 0.03 ELSE 0.0 END), 4) AS ranking_score FROM pool),
        top AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ranking_score DESC, round_even(similarity, 9) DESC, thread_id, k) AS rank
            FROM adjusted QUALIFY rank <= 3)
        SELECT doc_id, rank, thread_id AS match_id, ranking_score, sha256(reply) AS reply_digest FROM top""",
    "transcript_turns": f"""WITH {parsed(WHOLE_BLOCKS)}
        SELECT block_id, row_number() OVER (PARTITION BY block_id ORDER BY segment) - 1 AS position, role, body AS text FROM parsed""",
    "transcript_threads": f"""WITH {parsed(WHOLE_BLOCKS)},
        sides AS (
            SELECT block_id AS thread_id, arg_min(body, segment) FILTER (WHERE role = 'customer') AS customer_message,
                   arg_min(body, segment) FILTER (WHERE role = 'support') AS agent_reply, count(*) AS turns_count,
                   count(*) FILTER (WHERE role = 'customer') AS num_customer_turns,
                   count(*) FILTER (WHERE role = 'support') AS num_support_turns,
                   CAST(to_json(list({{'role': role, 'text': body}} ORDER BY segment)) AS VARCHAR) AS raw_turns_json
            FROM parsed GROUP BY block_id)
        SELECT *, {like('agent_reply', BOILERPLATE)} AS is_boilerplate FROM sides
        WHERE length(customer_message) >= 8 AND length(agent_reply) >= 8""",
    "reply_fanout": f"""
        WITH firsts AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id),
        pairs AS (
            SELECT 'tw_' || CAST(f.conv_id AS VARCHAR) || ':' || CAST(f.turn AS VARCHAR) AS thread_id,
                   {clean('c.text')} AS customer_message, {clean('r.text')} AS agent_reply
            FROM firsts f JOIN conversations c USING (conv_id, turn) JOIN conversations r ON r.conv_id = f.conv_id AND r.role = 'assistant')
        SELECT thread_id, customer_message, agent_reply, {like('agent_reply', BOILERPLATE)} AS is_boilerplate
        FROM pairs WHERE length(customer_message) >= 8 AND length(agent_reply) >= 8""",
    "thread_union": f"""WITH {THREADS},
        pairs AS (
            SELECT 'tw_' || CAST(c.conv_id AS VARCHAR) || ':' || CAST(c.turn AS VARCHAR) AS thread_id,
                   {clean('c.text')} AS customer_message, {clean('r.text')} AS agent_reply
            FROM conversations c JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1
            WHERE r.role = 'assistant')
        SELECT thread_id, customer_message, agent_reply FROM threads
        UNION ALL SELECT * FROM pairs WHERE length(customer_message) >= 8 AND length(agent_reply) >= 8""",
    "judge_json": f"""{JUDGED}
        SELECT doc_id, is_applicable, groundedness, correctness, tone_empathy, completeness, {OVERALL} AS overall,
               CASE WHEN answered THEN 'llm' WHEN is_applicable THEN 'heuristic' END AS judge_type FROM scored""",
    "judge_labels": f"""{JUDGED},
        grouped AS (
            SELECT CASE WHEN doc_id % 2 = 1 THEN 'some' WHEN toxic = 1 THEN 'none' ELSE 'all' END AS answers, is_applicable, answered,
                   {OVERALL} AS overall FROM scored)
        SELECT answers, count(overall) AS n_evaluated_replies, count(*) AS judged_cases,
               round_even({share('sum(overall)', 'count(overall)')}, 2) AS avg_overall,
               CASE WHEN count(*) FILTER (WHERE answered) = count(overall) AND count(overall) > 0 THEN 'LLM-as-a-Judge'
                    WHEN count(*) FILTER (WHERE answered) > 0 THEN 'LLM-as-a-Judge (' || count(*) FILTER (WHERE answered) || '/'
                         || count(overall) || ' successful, rest heuristic)'
                    ELSE 'Deterministic Offline Heuristic Rubric (LLM Fallback)' END AS judge_label
        FROM grouped GROUP BY answers""",
    "judge_prompts": """
        WITH p AS (
            SELECT doc_id, 'Message: "' || text || '"' || chr(10) || 'Must contain: "' || coalesce(lang, '') || '"' || chr(10) || 'Precedent: "'
                   || coalesce(CASE WHEN n_chars > 500 THEN source END, 'None') || '"' || chr(10) || 'Reply: "' || source || '"'
                   || chr(10) || chr(10) || 'Scores as JSON:' AS prompt FROM documents)
        SELECT doc_id, length(prompt) AS prompt_chars, sha256(prompt) AS prompt_digest FROM p""",
    "report_json": f"""WITH {PREDICTIONS}
        SELECT system, max(accuracy) FILTER (WHERE slice = 'overall') AS accuracy_overall,
               max(macro_f1) FILTER (WHERE slice = 'adversarial') AS macro_f1_adversarial,
               max(escalation_recall) FILTER (WHERE slice = 'overall') AS escalation_recall,
               max(n_evaluated_replies) FILTER (WHERE slice = 'overall') AS n_evaluated_replies,
               max(judge_label) FILTER (WHERE slice = 'overall') AS judge_label
        FROM results GROUP BY system""",
    "csv_rows": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_digest FROM documents",
    "json_rows": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_digest FROM documents",
    "encode_letters": """
        WITH counts AS (
            SELECT doc_id, unnest([0, 1, 2, 3]) AS position,
                   unnest([length(text) - length(replace(text, c, '')) FOR c IN ['a', 'e', 'n', 'o']])::DOUBLE AS n FROM documents),
        sizes AS (SELECT doc_id, sqrt(sum(n * n)) AS size FROM counts GROUP BY doc_id)
        SELECT doc_id, position::BIGINT AS position, round_even(CAST(CASE WHEN size > 0 THEN n / size ELSE 0.0 END AS FLOAT)::DOUBLE, 5) AS value
        FROM counts JOIN sizes USING (doc_id)""",
}
# The same answers by another way.
ORACLES["indexed_neighbours"] = ORACLES["knn_cells"]
ORACLES["indexed_replies"] = ORACLES["rerank_topk"]
ORACLES["csv_file_rows"] = ORACLES["csv_rows"]
ORACLES["jsonl_file_rows"] = """
    SELECT doc_id % 7 NOT IN (3, 5) AS good, CASE WHEN doc_id % 7 NOT IN (3, 5) THEN doc_id END AS doc_id,
           sha256(CASE doc_id % 7 WHEN 3 THEN 'not json ' || doc_id WHEN 5 THEN '{"doc_id": ' || doc_id ELSE text END) AS digest
    FROM documents"""
ORACLES["silhouette_euclidean"] = ORACLES["silhouette"].replace("pow(list_distance(a.v, b.v), 2)", "list_distance(a.v, b.v)")
ORACLES["sweep_iteration"] = """
    WITH runs AS (SELECT k, r, j FROM range(6, 13) a(k), range(5) b(r), range(12) c(j) WHERE j < k),
    points AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    centres AS (SELECT k, r, j, v FROM runs JOIN points ON vec_id = 7 * r + j),
    near AS (
        SELECT k, r, vec_id, p.v, arg_min(j, (list_distance(p.v, c.v), j)) AS cluster, min(pow(list_distance(p.v, c.v), 2)) AS d
        FROM points p CROSS JOIN centres c GROUP BY k, r, vec_id, p.v)
    SELECT k, r AS restart, cluster, count(*) AS members, round_even(sum(d), 5) AS cost, round_even(sum(v[1]), 5) AS first
    FROM near GROUP BY k, r, cluster"""
ORACLES["many_keywords"] = r"""
    WITH words AS (
        SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}]+')) AS word FROM benchmark) WHERE length(word) >= 5),
    lowered AS (SELECT doc_id, lower(text) AS t FROM documents),
    hits AS (SELECT doc_id, word FROM lowered JOIN words ON contains(t, word))
    SELECT doc_id, count(word) AS found, min(word) AS first FROM documents LEFT JOIN hits USING (doc_id) GROUP BY doc_id"""
