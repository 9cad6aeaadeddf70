"""SQL (DuckDB) for the registered queries, from the same tables."""

from __future__ import annotations

from ..functions import vocab
from ..operators import surface
from .fixtures import cte
from .queries import ITERATIONS


def strings(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def r6(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) + 0.0 AS {name or x}"


AUX, PREPS = strings(surface.AUXILIARIES), strings(surface.PREPOSITIONS)

EXTRAPOSED = (
    "coalesce(subjtype = 'PRON' AND lower(trim(subject_text)) = 'it' AND ("
    + " OR ".join(f"strpos(lower(surface), '{m}') - 1 > {vocab.EXTRAPOSITION_BEYOND}" for m in vocab.EXTRAPOSITION_MARKERS)
    + "), false)"
)
REASON = f"""CASE WHEN surface IS NULL OR tam IS NULL OR comp IS NULL OR subjtype IS NULL OR pattern IS NULL OR head_lemma IS NULL THEN 'missing_fields'
    WHEN tam NOT IN {strings(vocab.VALID_TAM)} THEN 'invalid_tam' WHEN {EXTRAPOSED} THEN 'extraposed_it' END"""


def subject_type(x: str) -> str:
    t = f"lower(trim({x}))"
    return f"""CASE WHEN {t} IN {strings(vocab.PRONOUNS)} THEN 'PRON'
        WHEN starts_with({t}, 'the ') OR starts_with({t}, 'this ') OR starts_with({t}, 'that ') THEN CASE WHEN {t} LIKE '%s' THEN 'PL_NP' ELSE 'DEF_NP' END
        WHEN starts_with({t}, 'a ') OR starts_with({t}, 'an ') THEN 'INDEF_NP' ELSE 'DEF_NP' END"""


def tam(s: str, m: str, modal: str) -> str:
    return f"""CASE WHEN len({s}) = 0 THEN 'unknown' WHEN {modal} AND list_contains({m}, 'be') THEN 'modal-be' WHEN {s} = ['was'] OR {s} = ['were'] THEN 'past-be' WHEN {s} = ['is'] OR {s} = ['are'] OR {s} = ['am'] THEN 'pres-be'
        WHEN (list_contains({m}, 'have') OR list_contains({s}, 'has') OR list_contains({s}, 'have')) AND (list_contains({s}, 'been') OR list_contains({m}, 'be')) THEN 'perf-be' WHEN list_contains({s}, 'being') AND list_contains({m}, 'be') THEN 'prog-be'
        WHEN list_contains({m}, 'get') THEN 'get-be' ELSE 'unknown' END"""


MODALS = "[" + ", ".join(f"'{w}'" for w in vocab.MODALS) + "]"
SENTENCES = "regexp_split_to_array(lower(text), '[.!?]')"

RAW = f"""sents AS (SELECT doc_id::VARCHAR AS doc_id, unnest({SENTENCES}) AS s, generate_subscripts({SENTENCES}, 1) - 1 AS sent_idx FROM documents WHERE lang = 'en'),
words AS (SELECT doc_id, sent_idx, regexp_extract_all(s, '[a-z]+') AS w FROM sents),
hits AS (SELECT doc_id, sent_idx, w, unnest(range(1, len(w)))::INTEGER AS i FROM words),
back AS (SELECT *, CASE WHEN i = 1 OR w[i - 1] NOT IN {AUX} THEN 0 WHEN i = 2 OR w[i - 2] NOT IN {AUX} THEN 1 WHEN i = 3 OR w[i - 3] NOT IN {AUX} THEN 2 ELSE 3 END AS b
    FROM hits WHERE w[i] IN {strings(surface.LAST)} AND w[i + 1] NOT IN {AUX}),
found AS (SELECT doc_id, sent_idx, (i - 1)::BIGINT AS pos, CASE WHEN i - b > 1 THEN w[i - b - 1] END AS subject_text, w[i - b : i] AS aux, w[i + 1] AS head_lemma, w[i + 2] AS next_word,
    list_filter(w[i + 2 :], lambda x: x NOT IN {strings(surface.FUNCTION_WORDS)})[1] AS following_word FROM back),
lemmas AS (SELECT *, list_transform(aux, lambda x: CASE WHEN x IN {strings(surface.BE)} THEN 'be' WHEN x IN {strings(surface.GET)} THEN 'get' WHEN x IN {strings(surface.HAVE)} THEN 'have' ELSE x END) AS m FROM found),
typed AS (SELECT *, doc_id || ':' || sent_idx || ':' || pos AS row_id, array_to_string(aux, ' ') || ' ' || head_lemma AS chain,
    CASE WHEN next_word = 'by' THEN 'by_NP' WHEN next_word IN {PREPS} THEN 'pp_' || next_word || '_NP' ELSE 'Ø' END AS comp,
    {tam("aux", "m", f"list_has_any(m, {MODALS})")} AS tam,
    {subject_type("subject_text")} AS subjtype FROM lemmas),
raw AS (SELECT *, tam || ',' || comp AS pattern, concat_ws(' ', subject_text, array_to_string(aux, ' '), head_lemma, CASE WHEN comp <> 'Ø' THEN next_word END) AS surface FROM typed),
judged AS (SELECT *, {REASON} AS reason FROM raw),
valid AS (SELECT * FROM judged WHERE reason IS NULL)"""

COUNTS = """ch AS (SELECT chain, count(*) AS n FROM valid GROUP BY 1),
cw AS (SELECT chain, n, unnest(string_split(chain, ' ')) AS word, generate_subscripts(string_split(chain, ' '), 1) AS k FROM ch),
uni AS (SELECT word, sum(n)::BIGINT AS n FROM cw GROUP BY 1),
pr AS (SELECT a.chain, a.n, a.k, a.word AS w1, b.word AS w2 FROM cw a JOIN cw b ON b.chain = a.chain AND b.k = a.k + 1),
bi AS (SELECT w1, w2, sum(n)::BIGINT AS n FROM pr GROUP BY 1, 2),
fol AS (SELECT pattern, following_word AS word, count(*) AS n FROM valid WHERE following_word IS NOT NULL GROUP BY 1, 2),
hr AS (SELECT pattern, sum(-q * log2(q)) AS instance_hr FROM (SELECT pattern, n / sum(n) OVER (PARTITION BY pattern) AS q FROM fol) GROUP BY 1)"""

SCORED = f"""{RAW},
{COUNTS},
cm AS (SELECT pr.chain, avg(((b.n / a.n - h.n / t.t) + (b.n / h.n - a.n / t.t)) / 2) AS instance_atp, arg_max(b.n / h.n - a.n / t.t, pr.k) AS instance_dpb
    FROM pr JOIN bi b USING (w1, w2) JOIN uni a ON a.word = pr.w1 JOIN uni h ON h.word = pr.w2, (SELECT sum(n)::DOUBLE AS t FROM uni) t GROUP BY 1),
scored AS (SELECT v.*, cm.instance_atp, cm.instance_dpb, hr.instance_hr FROM valid v JOIN cm ON cm.chain = v.chain LEFT JOIN hr ON hr.pattern = v.pattern),
kept AS (SELECT * FROM scored WHERE instance_atp >= {vocab.ATP} AND instance_dpb >= {vocab.DPB} AND instance_hr <= {vocab.HR})"""


def metrics(rows: str, p: str, by: tuple[str, ...] = ()) -> str:
    """Common table expressions; the last, named p, has all metrics of the patterns of ``rows``."""
    b = "".join(f"{c}, " for c in by)
    over = f"PARTITION BY {', '.join(by)}" if by else ""
    inner = f"PARTITION BY {b}" if by else "PARTITION BY "
    return f"""{p}_d AS (SELECT {b}pattern, doc_id, count(*)::DOUBLE AS n, sum(instance_atp) AS a, sum(instance_dpb) AS d FROM {rows} GROUP BY ALL),
{p}_p AS (SELECT {b}pattern, sum(n) AS o, count(*) AS n_docs, sum(a) / sum(n) AS atp, sum(d) / sum(n) AS delta_p FROM {p}_d GROUP BY ALL),
{p}_q AS (SELECT *, split_part(pattern, ',', 1) AS t, split_part(pattern, ',', 2) AS c, sum(o) OVER ({over}) AS nn, (count(*) OVER ({over}))::DOUBLE AS k FROM {p}_p),
{p}_r AS (SELECT *, sum(o) OVER ({inner}t) AS nt, sum(o) OVER ({inner}c) AS nc FROM {p}_q),
{p}_s AS (SELECT {b}doc_id, sum(n) AS dn FROM {p}_d GROUP BY ALL),
{p}_x AS (SELECT {b}pattern, 0.5 * (sum(abs(n / o - dn / nn)) + 1 - sum(dn / nn)) AS dispersion FROM {p}_d JOIN {p}_s USING ({b}doc_id) JOIN {p}_r USING ({b}pattern) GROUP BY ALL),
{p}_h AS (SELECT {b}pattern, sum(-q * log2(q)) AS h_slot FROM (SELECT {b}pattern, n / sum(n) OVER ({inner}pattern) AS q FROM (SELECT {b}pattern, coalesce(head_lemma, 'unknown') AS head_lemma, count(*) AS n FROM {rows} GROUP BY ALL)) GROUP BY ALL),
{p}_m AS (SELECT {b}pattern, o::BIGINT AS n_tokens, n_docs, atp, delta_p, h_slot, CASE WHEN o < nn THEN log2((o / nn) / ((nt / nn) * (nc / nn))) / (-log2(o / nn)) ELSE 0.0 END AS npmi, dispersion,
    CASE WHEN k <= 1 THEN 0.0 ELSE 2 * (o * ln(o / (nn / k)) + CASE WHEN nn > o THEN (nn - o) * ln((nn - o) / (nn - nn / k)) ELSE 0.0 END) END AS g_squared FROM {p}_r JOIN {p}_x USING ({b}pattern) JOIN {p}_h USING ({b}pattern)),
{p}_v AS (SELECT *, CASE WHEN g_squared > 0 THEN exp(-g_squared / 2) ELSE 1.0 END AS p_value FROM {p}_m),
{p}_k AS (SELECT *, row_number() OVER ({over} ORDER BY p_value, pattern) AS rk, count(*) OVER ({over}) AS m FROM {p}_v),
{p} AS (SELECT * EXCLUDE (rk, m), least(1.0, min(p_value * m / rk) OVER ({over} ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_value_fdr FROM {p}_k)"""


def lanes(p: str, out: str, npmi: float | str = vocab.NPMI, h_slot: float | str = vocab.H_SLOT) -> str:
    return f"""{out}_0 AS (SELECT *, npmi >= {npmi} AND g_squared >= {vocab.G2_NPMI} AS npmi_pass, h_slot >= {h_slot} AND g_squared >= {vocab.G2_H_SLOT} AND npmi >= {vocab.NPMI_FLOOR} AS h_slot_pass FROM {p}),
{out} AS (SELECT *, npmi_pass OR h_slot_pass AS accepted, CASE WHEN npmi_pass AND h_slot_pass THEN 'Both' WHEN npmi_pass THEN 'NPMI' WHEN h_slot_pass THEN 'H_slot' END AS lane FROM {out}_0)"""


PM = f"{SCORED},\n{metrics('kept', 'pm')},\n{lanes('pm', 'acc')}"
PARTS = "parts AS (SELECT l_returnflag || ',' || p_type AS pattern, p_brand AS head_lemma, l_suppkey::VARCHAR AS doc_id, 0.0::DOUBLE AS instance_atp, 0.0::DOUBLE AS instance_dpb FROM lineitem JOIN part ON l_partkey = p_partkey)"
TP = f"{PARTS},\n{metrics('parts', 'pm')},\n{lanes('pm', 'acc')}"
NUMBERS = ["atp", "delta_p", "h_slot", "npmi", "dispersion", "g_squared", "p_value", "p_value_fdr"]


def shuffle(column: str, within: str = "") -> str:
    """``copies``: the replicates of kept, with a column dealt anew."""
    own, part, using = (f"PARTITION BY {within}", f", {within}", f", {within}") if within else ("", "", "")
    rest = ", ".join(c for c in ("row_id", "doc_id", "tam", "comp", "head_lemma", "instance_atp", "instance_dpb") if c != column)
    return f"""iters AS (SELECT unnest(range(0, {ITERATIONS}))::INTEGER AS iter),
vals AS (SELECT {within + ", " if within else ""}{column}, row_number() OVER ({own} ORDER BY md5('42:' || row_id), row_id) AS rn FROM kept),
dealt AS (SELECT iter, {rest}, row_number() OVER (PARTITION BY iter{part} ORDER BY md5('42:' || iter || ':' || row_id), row_id) AS rn FROM kept, iters),
copies AS (SELECT iter, tam || ',' || comp AS pattern, doc_id, head_lemma, instance_atp, instance_dpb FROM dealt JOIN vals USING (rn{using}))"""


RESULTS = """real AS (SELECT pattern FROM acc WHERE accepted),
tried AS (SELECT i.iter, count(p.pattern) AS n_accepted, count(r.pattern) AS n_shared FROM iters i LEFT JOIN (SELECT * FROM sacc WHERE accepted) p ON p.iter = i.iter LEFT JOIN real r ON r.pattern = p.pattern GROUP BY 1),
known AS (SELECT *, (SELECT count(*) FROM real) AS n_real FROM tried),
results AS (SELECT *, CASE WHEN n_accepted = 0 AND n_real = 0 THEN 1.0 ELSE n_shared / (n_accepted + n_real - n_shared)::DOUBLE END AS jaccard FROM known)"""


def replicates(column: str, within: str = "") -> str:
    return f"{PM},\n{shuffle(column, within)},\n{metrics('copies', 'sm', ('iter',))},\n{lanes('sm', 'sacc')},\n{RESULTS}"


SHOW = f"SELECT iter, n_accepted, n_shared, n_real, {r6('jaccard')} FROM results"


def spread(x: str, name: str) -> str:
    return f"{r6(f'avg({x})', f'mean_{name}')}, {r6(f'stddev_pop({x})', f'std_{name}')}, min({x}) AS min_{name}, max({x}) AS max_{name}, {r6(f'quantile_cont({x}, 0.5)', f'median_{name}')}"


def settings() -> str:
    base = {"atp": vocab.ATP, "dpb": vocab.DPB, "hr": vocab.HR, "npmi": vocab.NPMI, "h_slot": vocab.H_SLOT}
    rows = [(p, v, *(base | {p: v}).values()) for p, vs in vocab.GRID.items() for v in vs]
    body = ", ".join("('" + r[0] + "', " + ", ".join(f"{x}::DOUBLE" for x in r[1:]) + ")" for r in rows)
    return f"grid AS (SELECT * FROM (VALUES {body}) AS v(param, value, t_atp, t_dpb, t_hr, t_npmi, t_h))"


GRID = f"""{PM},
{settings()},
many AS (SELECT param, value, pattern, doc_id, head_lemma, instance_atp, instance_dpb FROM scored, grid WHERE instance_atp >= t_atp AND instance_dpb >= t_dpb AND instance_hr <= t_hr),
{metrics('many', 'gm', ('param', 'value'))},
gj AS (SELECT gm.*, t_npmi, t_h FROM gm JOIN grid USING (param, value)),
{lanes('gj', 'gacc', 't_npmi', 't_h')},
ok AS (SELECT param, value, pattern FROM gacc WHERE accepted),
stable AS (SELECT param, pattern, count(*) AS n FROM ok GROUP BY ALL HAVING count(*) >= 3)"""

MEMBERS = f"""{PM},
{metrics('scored', 'am')},
{lanes('am', 'aacc')},
members AS (SELECT 'FULL' AS config, pattern FROM acc WHERE accepted UNION ALL SELECT 'NPMI_ONLY', pattern FROM acc WHERE npmi_pass UNION ALL SELECT 'H_SLOT_ONLY', pattern FROM acc WHERE h_slot_pass
    UNION ALL SELECT 'NO_LAYER1', pattern FROM aacc WHERE accepted UNION ALL SELECT 'FREQ_ONLY', pattern FROM scored GROUP BY pattern HAVING count(*) >= 3),
has AS (SELECT pattern, bool_or(config = 'FULL') AS f, bool_or(config = 'NO_LAYER1') AS n1, bool_or(config = 'NPMI_ONLY') AS a, bool_or(config = 'H_SLOT_ONLY') AS b, bool_or(config = 'FREQ_ONLY') AS q FROM members GROUP BY 1)"""

FILTERS = f"""{SCORED},
conf AS (SELECT * FROM (VALUES ('full_pipeline', {vocab.ATP}::DOUBLE, {vocab.DPB}::DOUBLE, {vocab.HR}::DOUBLE), ('no_atp', -1e9, {vocab.DPB}, {vocab.HR}), ('no_dpb', {vocab.ATP}, -1e9, {vocab.HR}), ('no_hr', {vocab.ATP}, {vocab.DPB}, 'inf'::DOUBLE)) AS v(config, t_atp, t_dpb, t_hr)),
many AS (SELECT config, pattern, doc_id, head_lemma, instance_atp, instance_dpb FROM scored, conf WHERE instance_atp >= t_atp AND instance_dpb >= t_dpb AND coalesce(instance_hr, 'inf'::DOUBLE) <= t_hr),
{metrics('many', 'fm', ('config',))},
{lanes('fm', 'facc')},
ab AS (SELECT c.config, coalesce(sum(n_tokens), 0)::BIGINT AS formulaic_count, count(*) FILTER (accepted) AS schema_count FROM conf c LEFT JOIN facc USING (config) GROUP BY 1)"""

EXAMPLES = f"""{PM},
ex AS (SELECT k.pattern, row_number() OVER (PARTITION BY k.pattern ORDER BY md5('42:' || row_id), row_id)::INTEGER AS rank, surface, coalesce(subject_text, '') AS subject, k.head_lemma AS verb, doc_id, instance_atp AS atp, instance_dpb AS dpb, instance_hr AS hr
    FROM kept k SEMI JOIN (SELECT pattern FROM acc WHERE accepted) a ON a.pattern = k.pattern QUALIFY rank <= 5)"""


def mapped(x: str, table: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def preposition(x: str) -> str:
    p = f"lower(trim({x}))"
    good = {k: v for k, v in vocab.PREP_CORRECTIONS.items() if v in vocab.VALID_PREPOSITIONS and v not in vocab.INVALID_PREPS}
    return f"CASE WHEN {x} IS NULL OR {x} = '' OR {p} IN {strings(vocab.INVALID_PREPS)} THEN NULL WHEN {p} IN {strings(vocab.PREP_CORRECTIONS)} THEN {mapped(p, good)} ELSE {p} END"


def complement(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL OR {x} = '' THEN NULL WHEN {x} IN ('Ø', 'to_VP', 'by_NP') THEN {x} WHEN starts_with({x}, 'by_NP[ENT=') THEN 'by_NP'
        WHEN {x} LIKE 'pp\\_%\\_NP' ESCAPE '\\' THEN 'pp_' || ({preposition(f"substr({x}, 4, length({x}) - 6)")}) || '_NP' ELSE {x} END"""


def pattern(x: str) -> str:
    head, tail = f"split_part({x}, ',', 1)", f"substr({x}, strpos({x}, ',') + 1)"
    return f"CASE WHEN {x} = '' THEN NULL WHEN strpos({x}, ',') = 0 THEN {x} ELSE {head} || ',' || ({complement(tail)}) END"


NORMAL = f"""{cte('pattern_cases')},
n0 AS (SELECT id, comp AS c, pattern AS p, {complement('comp')} AS comp, {pattern('pattern')} AS pattern FROM pattern_cases),
n1 AS (SELECT *, CASE WHEN comp IS NOT NULL AND pattern IS NOT NULL AND comp <> c AND starts_with(c, 'pp_') AND starts_with(comp, 'pp_') THEN regexp_replace(substr(c, 4), '_NP$', '') || ' → ' || regexp_replace(substr(comp, 4), '_NP$', '') END AS correction FROM n0),
n2 AS (SELECT *, CASE WHEN comp IS NULL OR pattern IS NULL THEN 'filtered' WHEN correction IS NOT NULL THEN 'normalized' ELSE 'unchanged' END AS outcome FROM n1)"""

MERGE = f"""{cte('merge_cases')},
m0 AS (SELECT *, {pattern('pattern')} AS norm FROM merge_cases)"""


def without_ed(x: str) -> str:
    """Without -ed, a doubled consonant, and with y for i."""
    stem = f"left({x}, length({x}) - 2)"
    doubled = "|".join(c + c for c in vocab.DOUBLED)
    return f"regexp_replace(CASE WHEN length({stem}) > 2 AND regexp_matches({stem}, '({doubled})$') THEN left({stem}, length({stem}) - 1) ELSE {stem} END, 'i$', 'y')"


def judged_lemmas(lemmas: str) -> str:
    """``lem``: (lemma, final, status) of the distinct lemmas of a table with a column lemma."""
    joined = " ".join(f"WHEN starts_with(w, '{k}') AND length(w) > {len(k)} THEN '{v}'" for k, v in vocab.JOINED_PARTICIPLES.items())
    second = "^(" + "|".join(vocab.JOINED_BEGINNINGS) + ")"
    first = f"left(w, list_filter(range(4, least(length(w), 12)), lambda e: regexp_matches(substr(w, e + 1), '{second}'))[1]::INTEGER)"
    bad = "NOT regexp_full_match({0}, '[a-z-]{{3,24}}')"
    return f"""RECURSIVE chain AS (
    SELECT lemma, lower(trim(lemma)) AS w, 0 AS step FROM (SELECT DISTINCT lemma FROM {lemmas}) WHERE lemma IS NOT NULL
    UNION ALL
    SELECT lemma, c, step + 1 FROM (SELECT lemma, w, step, CASE WHEN w LIKE '%ed' AND length(w) > 4 AND length({without_ed('w')}) >= 3 THEN {without_ed('w')}
        WHEN w LIKE '%en' AND length(w) > 4 THEN left(w, length(w) - 2) {joined}
        WHEN length(w) > 8 THEN CASE WHEN {first} LIKE '%ed' AND length({first}) > 4 THEN {without_ed(first)} ELSE {first} END END AS c
        FROM chain WHERE w NOT IN {strings(vocab.VERB_CORRECTIONS)} AND regexp_full_match(w, '[a-z-]{{3,24}}'))
    WHERE c <> w AND regexp_full_match(c, '[a-z-]{{3,24}}')),
ends AS (SELECT lemma, arg_max(w, step) AS w, max(step) AS steps, arg_min(w, step) AS given FROM chain GROUP BY lemma),
lem AS (SELECT l.lemma, CASE WHEN given IS NULL OR {bad.format('given')} THEN NULL ELSE coalesce({mapped('w', vocab.VERB_CORRECTIONS)}, w) END AS final,
    CASE WHEN given IS NULL OR {bad.format('given')} THEN 'filtered' WHEN given IN {strings(vocab.VERB_CORRECTIONS)} THEN 'corrected' WHEN w <> given THEN 'tokenization_error' ELSE 'valid' END AS status
    FROM (SELECT DISTINCT lemma FROM {lemmas}) l LEFT JOIN ends e ON e.lemma = l.lemma)"""


LINES = f"""{cte('asc_files')},
split AS (SELECT doc_id, unnest(regexp_split_to_array(value, '\\r\\n|\\n|\\r')) AS l, generate_subscripts(regexp_split_to_array(value, '\\r\\n|\\n|\\r'), 1) AS n FROM asc_files),
lines AS (SELECT doc_id, n, regexp_replace(l, '^\\s+|\\s+$', '', 'g') AS line FROM split),
cut AS (SELECT *, string_split(line, chr(9)) AS f, line <> '' AND NOT starts_with(line, '#') AND len(string_split(line, chr(9))) >= 3 AS tok FROM lines)"""


def numbered(ends: str, where: str = "true") -> str:
    return f"""{LINES},
fine AS (SELECT *, coalesce(max((tok AND try_cast(f[1] AS INTEGER) IS NULL)::INTEGER) OVER (PARTITION BY doc_id), 0) = 1 AS failed FROM cut),
grp AS (SELECT *, sum(({ends})::INTEGER) OVER (PARTITION BY doc_id ORDER BY n) AS g FROM fine WHERE {where}),
tokens AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY g)::INTEGER AS sent_idx, f FROM grp WHERE tok)"""


#: ``built``: a row a PASSIVE tag of tree_tokens that has a head in tree_parse. Subtrees are a recursive walk, not a rule over arrays.
TREES = f"""RECURSIVE {cte('tree_tokens')},
{cte('tree_parse')},
p AS (SELECT * FROM tree_parse),
walk AS (SELECT doc_id, sent_idx, i AS root, i FROM p UNION SELECT w.doc_id, w.sent_idx, w.root, c.i FROM walk w JOIN p c ON c.doc_id = w.doc_id AND c.sent_idx = w.sent_idx AND c.head_i = w.i AND c.i <> w.i),
up AS (SELECT doc_id, sent_idx, i, head_i AS at, (head_i <> i)::INTEGER AS n FROM p UNION SELECT u.doc_id, u.sent_idx, u.i, q.head_i, u.n + 1 FROM up u JOIN p q ON q.doc_id = u.doc_id AND q.sent_idx = u.sent_idx AND q.i = u.at WHERE q.head_i <> q.i),
depth AS (SELECT doc_id, sent_idx, i, max(n) AS n FROM up GROUP BY ALL),
below AS (SELECT doc_id, sent_idx, w.root, string_agg(q.text, ' ' ORDER BY q.i) AS phrase, min(q.i) AS lo, max(q.i) AS hi FROM walk w JOIN p q USING (doc_id, sent_idx, i) GROUP BY ALL),
tags AS (SELECT doc_id, sent_idx, token_num, lower(lemma) AS lemma FROM tree_tokens WHERE asc_tag = 'PASSIVE'),
head AS (SELECT doc_id, sent_idx, token_num, q.i, q.text, q.lemma FROM tags t JOIN p q USING (doc_id, sent_idx) WHERE lower(q.lemma) = t.lemma AND (q.tag IN ('VBN', 'VBD') OR q.pos = 'VERB')
    QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx, token_num ORDER BY q.tag NOT IN ('VBN', 'VBD'), q.i) = 1),
kid AS (SELECT doc_id, sent_idx, h.token_num, c.i, c.text, lower(c.text) AS low, c.lemma, c.pos, c.dep FROM head h JOIN p c USING (doc_id, sent_idx) WHERE c.head_i = h.i AND c.i <> h.i),
aux AS (SELECT doc_id, sent_idx, token_num, list(text ORDER BY i) AS words, list(lower(text) ORDER BY i) AS s, list(lower(lemma) ORDER BY i) AS m FROM kid WHERE dep IN ('aux', 'auxpass') GROUP BY ALL),
subject AS (SELECT doc_id, sent_idx, token_num, arg_min(i, ord) AS i FROM (SELECT doc_id, sent_idx, token_num, i, i AS ord FROM kid WHERE dep IN ('nsubjpass', 'csubj', 'csubjpass', 'nsubj')
    UNION ALL SELECT doc_id, sent_idx, a.token_num, c.i, 10000 + a.i * 100 + c.i FROM kid a JOIN p c USING (doc_id, sent_idx) WHERE a.dep IN ('aux', 'auxpass') AND c.head_i = a.i AND c.i <> a.i AND c.dep IN ('nsubjpass', 'nsubj')) GROUP BY ALL),
span AS (SELECT s.doc_id, s.sent_idx, s.token_num, b.phrase, b.lo, b.hi FROM subject s JOIN below b ON b.doc_id = s.doc_id AND b.sent_idx = s.sent_idx AND b.root = s.i),
crown AS (SELECT doc_id, sent_idx, s.token_num, arg_min(q, CASE WHEN q.head_i = q.i THEN -1 WHEN q.head_i BETWEEN lo AND hi THEN 1000000 + q.i ELSE d.n * 1000 + q.i END) AS r, bool_or(q.dep = 'det' AND lower(q.lemma) IN {strings(vocab.DEFINITE)}) AS definite, bool_or(q.dep = 'det' AND lower(q.lemma) IN {strings(vocab.INDEFINITE)}) AS indefinite
    FROM span s JOIN p q USING (doc_id, sent_idx) JOIN depth d USING (doc_id, sent_idx, i) WHERE q.i BETWEEN lo AND hi GROUP BY ALL),
part AS (SELECT k.*, b.phrase, CASE WHEN low = 'by' AND pos = 'ADP' THEN 'by' WHEN dep = 'prep' AND pos = 'ADP' THEN 'pp' WHEN dep = 'xcomp' THEN 'vp' END AS kind FROM kid k JOIN below b ON b.doc_id = k.doc_id AND b.sent_idx = k.sent_idx AND b.root = k.i),
pps AS (SELECT doc_id, sent_idx, token_num, low, min(i) AS place, arg_max(phrase, i) AS phrase FROM part WHERE kind = 'pp' GROUP BY ALL),
ends AS (SELECT doc_id, sent_idx, token_num, arg_max(phrase, i) FILTER (kind = 'by') AS by_text, arg_max(phrase, i) FILTER (kind = 'vp') AS vp_text FROM part GROUP BY ALL),
pp AS (SELECT doc_id, sent_idx, token_num, arg_min(low, place) AS prep, arg_min(phrase, place) AS pp_text, string_agg('pp_' || low || '=' || phrase, '; ' ORDER BY low) AS pp_all FROM pps GROUP BY ALL),
follow AS (SELECT doc_id, sent_idx, h.token_num, arg_min(q.text, q.i) AS following_word FROM head h JOIN p q USING (doc_id, sent_idx) WHERE q.i > h.i AND q.pos IN ('NOUN', 'VERB', 'ADJ', 'ADV', 'PROPN') GROUP BY ALL),
gathered AS (SELECT doc_id, sent_idx, token_num, h.text, h.lemma AS head_lemma, coalesce(a.words, []) AS words, coalesce(a.s, []) AS s, coalesce(a.m, []) AS m, sp.phrase AS subject_text, e.by_text, e.vp_text, pp.prep, pp.pp_text, pp.pp_all, f.following_word, c.r, c.definite, c.indefinite
    FROM head h LEFT JOIN aux a USING (doc_id, sent_idx, token_num) LEFT JOIN span sp USING (doc_id, sent_idx, token_num) LEFT JOIN crown c USING (doc_id, sent_idx, token_num) LEFT JOIN ends e USING (doc_id, sent_idx, token_num) LEFT JOIN pp USING (doc_id, sent_idx, token_num) LEFT JOIN follow f USING (doc_id, sent_idx, token_num)),
built AS (SELECT *, {tam('s', 'm', f'list_has_any(m, {MODALS})')} AS tam, CASE WHEN by_text IS NOT NULL THEN 'by_NP' WHEN prep IS NOT NULL THEN 'pp_' || prep || '_NP' WHEN vp_text IS NOT NULL THEN 'to_VP' ELSE 'Ø' END AS comp,
    CASE WHEN subject_text IS NULL THEN 'DEF_NP' WHEN r.dep = 'expl' THEN 'EXPL' WHEN r.pos = 'PRON' THEN CASE WHEN lower(r.lemma) IN {strings(vocab.RELATIVE_PRONOUNS)} THEN 'REL' ELSE 'PRON' END WHEN r.pos = 'PROPN' THEN 'PROPN' WHEN r.number = 'Plur' THEN 'PL_NP'
        WHEN definite THEN 'DEF_NP' WHEN indefinite THEN 'INDEF_NP' ELSE 'DEF_NP' END AS subjtype,
    concat_ws(' ', subject_text, CASE WHEN len(words) > 0 THEN array_to_string(words, ' ') END, text, coalesce(by_text, vp_text, pp_text)) AS surface, array_to_string(list_append(words, text), ' ') AS chain FROM gathered)"""

HEADER = "starts_with(line, '# sent_id')"
LOOSE = numbered("line = '' OR starts_with(line, '#')")

ORACLES: dict[str, str] = {
    "flagship_patterns": f"WITH {PM} SELECT pattern, n_tokens, n_docs, {', '.join(map(r6, NUMBERS))}, accepted, lane FROM acc",
    "surface_constructions": f"WITH {RAW} SELECT row_id, surface, tam, comp, subjtype, pattern, head_lemma, subject_text, chain, following_word FROM raw",
    "filter_reasons": f"WITH {RAW} SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM judged GROUP BY 1",
    "invalid_tam": f"WITH {RAW} SELECT tam, count(*) AS n FROM judged WHERE reason = 'invalid_tam' GROUP BY 1",
    "filter_marginals": f"WITH {RAW} SELECT 'tam' AS kind, tam AS value, count(*) AS n FROM valid GROUP BY ALL UNION ALL SELECT 'comp', comp, count(*) FROM valid GROUP BY ALL UNION ALL SELECT 'subjtype', subjtype, count(*) FROM valid GROUP BY ALL",
    "tam_distribution": f"WITH {RAW} SELECT tam, count(*) AS n FROM raw GROUP BY 1",
    "unigram_counts": f"WITH {RAW}, {COUNTS} SELECT word, n FROM uni",
    "bigram_counts": f"WITH {RAW}, {COUNTS} SELECT w1, w2, n FROM bi",
    "follower_counts": f"WITH {RAW}, {COUNTS} SELECT pattern, word, n FROM fol",
    "boundary_entropy": f"WITH {RAW}, {COUNTS} SELECT pattern, {r6('instance_hr')} FROM hr",
    "instance_metrics": f"WITH {SCORED} SELECT row_id, {r6('instance_atp')}, {r6('instance_dpb')}, {r6('instance_hr')} FROM scored",
    "layer1_filter": f"WITH {SCORED} SELECT row_id, pattern, head_lemma, {r6('instance_atp')}, {r6('instance_dpb')}, {r6('instance_hr')} FROM kept",
    "layer1_attribution": f"WITH {SCORED} SELECT CASE WHEN NOT instance_atp >= {vocab.ATP} THEN 'atp' WHEN NOT instance_dpb >= {vocab.DPB} THEN 'dpb' WHEN instance_hr IS NULL OR instance_hr > {vocab.HR} THEN 'hr' ELSE 'formulaic' END AS reason, count(*) AS n FROM scored GROUP BY 1",
    "schema_atp_dp": f"WITH {SCORED}, {metrics('scored', 'pm')} SELECT pattern, n_tokens, n_docs, {r6('atp')}, {r6('delta_p')}, {r6('dispersion')} FROM pm",
    "slot_entropy": f"WITH {SCORED}, {metrics('scored', 'pm')} SELECT pattern, {r6('h_slot')} FROM pm",
    "npmi_tpch": f"WITH {TP} SELECT pattern, n_tokens, {r6('npmi')} FROM pm",
    "slot_entropy_tpch": f"WITH {TP} SELECT pattern, {r6('h_slot')} FROM pm",
    "dispersion_tpch": f"WITH {TP} SELECT pattern, n_docs, {r6('dispersion')} FROM pm",
    "g2_tpch": f"WITH {TP} SELECT pattern, {r6('g_squared')}, {r6('p_value')} FROM pm",
    "fdr_tpch": f"WITH {TP} SELECT pattern, {r6('p_value')}, {r6('p_value_fdr')} FROM pm",
    "dual_lane_tpch": f"WITH {TP} SELECT pattern, npmi_pass, h_slot_pass, accepted, lane FROM acc",
    "dual_lane_discovery": f"WITH {PARTS}, {metrics('parts', 'pm')}, {lanes('pm', 'acc', vocab.NPMI_DISCOVERY)} SELECT pattern, lane FROM acc WHERE accepted",
    "dual_lane_stats": f"""WITH {TP} SELECT count(*) AS total_patterns, count(*) FILTER (npmi_pass) AS lane1_npmi_passed, count(*) FILTER (NOT npmi_pass AND npmi < {vocab.NPMI}) AS lane1_npmi_failed, count(*) FILTER (NOT npmi_pass AND npmi >= {vocab.NPMI}) AS lane1_g2_failed,
        count(*) FILTER (h_slot_pass) AS lane2_h_slot_passed, count(*) FILTER (NOT h_slot_pass AND h_slot < {vocab.H_SLOT}) AS lane2_h_slot_failed, count(*) FILTER (NOT h_slot_pass AND h_slot >= {vocab.H_SLOT}) AS lane2_g2_failed,
        count(*) FILTER (npmi_pass AND NOT h_slot_pass) AS npmi_only_passed, count(*) FILTER (h_slot_pass AND NOT npmi_pass) AS h_slot_only_passed, count(*) FILTER (npmi_pass AND h_slot_pass) AS both_lanes_passed, count(*) FILTER (accepted) AS total_accepted,
        count(*) FILTER (h_slot >= {vocab.H_SLOT} AND g_squared >= {vocab.G2_H_SLOT} AND npmi < {vocab.NPMI_FLOOR}) AS h_slot_filtered_by_npmi_floor FROM acc""",
    "g2_contingency": f"""WITH e AS (SELECT event_type, count(*) FILTER (user_id % 2 = 0) AS even, count(*) FILTER (user_id % 2 <> 0) AS odd FROM events GROUP BY 1),
        t AS (SELECT *, sum(even) OVER ()::DOUBLE AS te, sum(odd) OVER ()::DOUBLE AS td FROM e),
        c AS (SELECT *, even + odd AS r1, te + td - even - odd AS r2, te + td AS n FROM t),
        g AS (SELECT event_type, even, odd, 2 * (CASE WHEN even > 0 THEN even * ln(even / (r1 * te / n)) ELSE 0 END + CASE WHEN odd > 0 THEN odd * ln(odd / (r1 * td / n)) ELSE 0 END
            + CASE WHEN te > even THEN (te - even) * ln((te - even) / (r2 * te / n)) ELSE 0 END + CASE WHEN td > odd THEN (td - odd) * ln((td - odd) / (r2 * td / n)) ELSE 0 END) AS g_squared FROM c)
        SELECT event_type, even, odd, {r6('g_squared')}, {r6('CASE WHEN g_squared > 0 THEN exp(-g_squared / 2) ELSE 1.0 END', 'p_value')} FROM g""",
    "freq_only": f"WITH {RAW} SELECT pattern, count(*) AS n FROM valid GROUP BY 1 HAVING count(*) >= 3",
    "accepted_venn": f"WITH {MEMBERS} SELECT pattern, CASE WHEN f AND n1 THEN 'both' WHEN f THEN 'FULL_only' ELSE 'NO_LAYER1_only' END AS part FROM has WHERE f OR n1",
    "layer_ablation": f"""WITH {MEMBERS} SELECT count(*) FILTER (f) AS n_full, count(*) FILTER (n1) AS n_no_layer1, count(*) FILTER (a) AS n_npmi_only, count(*) FILTER (b) AS n_h_slot_only, count(*) FILTER (q) AS n_freq_only,
        count(*) FILTER (n1) - count(*) FILTER (f) AS layer1_contribution, count(*) FILTER (n1 AND NOT f) AS layer1_filters_out, count(*) FILTER (a AND NOT b) AS npmi_unique, count(*) FILTER (b AND NOT a) AS h_slot_unique,
        count(*) FILTER (a AND b) AS both_lanes, count(*) FILTER (f AND NOT (a AND b)) AS rescued_by_or_logic FROM has""",
    "layer1_ablation": f"WITH {MEMBERS}, x AS (SELECT count(*) FILTER (f) AS w, count(*) FILTER (n1) AS o, count(*) FILTER (n1 AND NOT f) AS fp FROM has) SELECT w AS with_layer1, o AS without_layer1, fp AS false_positives, CASE WHEN o > 0 THEN round_even((o - w) * 100.0::DOUBLE / o, 1) ELSE 0.0 END AS reduction_percentage FROM x",
    "filter_ablation": f"WITH {FILTERS}, base AS (SELECT formulaic_count AS fc, schema_count AS sc FROM ab WHERE config = 'full_pipeline') SELECT config, formulaic_count, schema_count, formulaic_count - fc AS change_formulaic, schema_count - sc AS change_schemas FROM ab, base",
    "lane_ablation": f"""WITH {PM}, l AS (SELECT * FROM (SELECT count(*) FILTER (accepted) AS full_dual_lane, count(*) FILTER (npmi_pass) AS npmi_only, count(*) FILTER (h_slot_pass) AS h_slot_only, count(*) FILTER (npmi_pass AND h_slot_pass) AS both_required FROM acc)),
        u AS (UNPIVOT l ON COLUMNS(*) INTO NAME config VALUE schema_count) SELECT config, schema_count, schema_count - (SELECT full_dual_lane FROM l) AS change FROM u""",
    "tam_shuffle": f"WITH {replicates('tam')} {SHOW}",
    "comp_shuffle": f"WITH {replicates('comp')} {SHOW}",
    "verb_shuffle": f"WITH {replicates('head_lemma', 'tam')} {SHOW}",
    "perm_summary": f"""WITH {replicates('comp')}, s AS (SELECT *, CASE WHEN n_accepted >= n_real THEN 1.0 ELSE 0.0 END AS ge, CASE WHEN jaccard >= 0.5 THEN 1.0 ELSE 0.0 END AS half FROM results)
        SELECT count(*) AS n_iterations, max(n_real) AS observed, {spread('n_accepted', 'permuted')}, {r6('avg(jaccard)', 'mean_jaccard')}, {r6('stddev_pop(jaccard)', 'std_jaccard')}, {r6('min(jaccard)', 'min_jaccard')}, {r6('max(jaccard)', 'max_jaccard')}, {r6('quantile_cont(jaccard, 0.5)', 'median_jaccard')},
        {r6('avg(n_shared)', 'mean_overlap')}, max(n_shared) AS max_overlap, {r6('avg(ge)', 'p_value_count')}, {r6('avg(half)', 'p_value_identity')},
        {r6('CASE WHEN stddev_pop(n_accepted) > 0 THEN (max(n_real) - avg(n_accepted)) / stddev_pop(n_accepted) ELSE 0.0 END', 'z_score')}, avg(ge) < 0.05 AS count_test_significant, avg(jaccard) < 0.3 AS identity_test_valid FROM s""",
    "perm_histogram": f"""WITH {replicates('comp')}, e0 AS (SELECT min(n_accepted)::DOUBLE AS a, max(n_accepted)::DOUBLE AS b FROM results), e AS (SELECT CASE WHEN a < b THEN a ELSE a - 0.5 END AS a, CASE WHEN a < b THEN b ELSE b + 0.5 END AS b FROM e0 WHERE a IS NOT NULL),
        mine AS (SELECT least(floor((n_accepted - a) / ((b - a) / 20))::INTEGER + 1, 20) AS bin, count(*) AS n FROM results, e GROUP BY 1)
        SELECT x.bin::INTEGER AS bin, {r6('a + (x.bin - 1) * (b - a) / 20', 'low')}, {r6('a + x.bin * (b - a) / 20', 'high')}, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, 21))::INTEGER AS bin) x JOIN e ON true LEFT JOIN mine ON mine.bin = x.bin""",
    "sensitivity_grid": f"WITH {GRID} SELECT param, value, count(pattern) AS n_accepted FROM grid LEFT JOIN ok USING (param, value) GROUP BY ALL",
    "stable_schemas": f"WITH {GRID} SELECT param, pattern, n FROM stable",
    "schema_stability": f"""WITH {GRID}, pc AS (SELECT pattern, count(*) AS c FROM ok GROUP BY 1), sp AS (SELECT pattern, count(*) AS c FROM stable GROUP BY 1), o AS (SELECT pattern, coalesce(pc.c, 0) AS presence_count, coalesce(sp.c, 0) AS stable_params FROM (SELECT pattern FROM acc WHERE accepted) LEFT JOIN pc USING (pattern) LEFT JOIN sp USING (pattern))
        SELECT pattern, presence_count, round_even(presence_count / 25.0::DOUBLE * 100, 1) AS stability_percentage, CASE WHEN presence_count / 25.0::DOUBLE * 100 >= 80 THEN 'Globally stable' ELSE 'Parameter-sensitive' END AS classification, stable_params, stable_params = 5 AS globally_stable FROM o""",
    "globally_stable": f"WITH {GRID} SELECT pattern FROM stable GROUP BY 1 HAVING count(*) = 5",
    "examples_topk": f"WITH {EXAMPLES} SELECT pattern, rank, surface, subject, verb, doc_id, {r6('atp')}, {r6('dpb')}, {r6('hr')} FROM ex",
    "example_semantics": f"""WITH {EXAMPLES}, v AS (SELECT pattern, verb, count(*) AS n, sum(atp) AS a, sum(dpb) AS d, row_number() OVER (PARTITION BY pattern ORDER BY count(*) DESC, verb) AS k FROM ex GROUP BY 1, 2)
        SELECT pattern, sum(n)::BIGINT AS n_examples, count(*) AS unique_verbs, string_agg(verb || '(' || n || ')', ', ' ORDER BY k) FILTER (k <= 5) AS top_verbs, {r6('sum(a) / sum(n)', 'avg_atp')}, {r6('sum(d) / sum(n)', 'avg_dpb')} FROM v GROUP BY 1""",
    "multi_schema_verbs": f"WITH {PM}, s AS (SELECT DISTINCT head_lemma AS verb, k.pattern FROM kept k JOIN acc a ON a.pattern = k.pattern AND a.accepted) SELECT verb, count(*) AS n_patterns, string_agg(pattern, '|' ORDER BY pattern) AS patterns FROM s GROUP BY 1 HAVING count(*) > 1",
    "spatial_schemas": f"WITH {RAW} SELECT pattern, count(*) AS n, regexp_matches(pattern, '_({'|'.join(vocab.SPATIAL)})_') AS is_spatial FROM valid GROUP BY 1",
    "tam_classifier": f"""WITH {cte('tam_cases')}, t AS (SELECT id, modal, CASE WHEN surface = '' THEN [] ELSE string_split(lower(surface), ' ') END AS s, CASE WHEN lemmas = '' THEN [] ELSE string_split(lower(lemmas), ' ') END AS m FROM tam_cases)
        SELECT id, {tam("s", "m", "modal")} AS tam, list_has_any(m, {MODALS}) AS has_modal FROM t""",
    "comp_classifier": f"""WITH {cte('comp_cases')}, t AS (SELECT id, string_split(keys, ',') AS k, nullif(lower(prep_head), '') AS h FROM comp_cases)
        SELECT id, CASE WHEN list_contains(k, 'by_entity') OR h = 'by' THEN 'by_NP' WHEN h IS NOT NULL THEN 'pp_' || h || '_NP' WHEN list_has_any(k, ['to_inf', 'to_vp']) THEN 'to_VP'
        WHEN len(list_filter(k, lambda x: starts_with(x, 'pp_'))) > 0 THEN 'pp_' || split_part(list_filter(k, lambda x: starts_with(x, 'pp_'))[1], '_', 2) || '_NP' ELSE 'Ø' END AS comp FROM t""",
    "subj_classifier": f"WITH {cte('subject_cases')} SELECT id, {subject_type('subject_text')} AS subjtype FROM subject_cases",
    "enum_validate": f"WITH {cte('enum_cases')} SELECT id, coalesce(tam IN {strings(vocab.VALID_TAM + vocab.INVALID_TAM)}, false) AS tam_ok, coalesce(subjtype IN {strings(vocab.SUBJECT_TYPES)}, false) AS subj_ok, coalesce(comp IN ('Ø', 'to_VP', 'by_NP') OR (starts_with(comp, 'pp_') AND suffix(comp, '_NP')), false) AS comp_ok FROM enum_cases",
    "extraposed": f"WITH {cte('filter_cases')} SELECT id, {EXTRAPOSED} AS extraposed, {REASON} AS reason FROM filter_cases",
    "prep_normalize": f"WITH {cte('prep_cases')} SELECT id, {preposition('prep')} AS prep FROM prep_cases",
    "pattern_normalize": f"WITH {NORMAL} SELECT id, comp, pattern, outcome, correction FROM n2",
    "normalize_counts": f"WITH {NORMAL} SELECT outcome, CASE WHEN outcome = 'filtered' THEN p ELSE correction END AS detail, count(*) AS n FROM n2 GROUP BY ALL",
    "pattern_merge": f"WITH {MERGE} SELECT norm AS pattern, sum(n_tokens)::BIGINT AS n_tokens, max(n_docs) AS n_docs, arg_min(npmi, ord) AS npmi FROM m0 WHERE norm IS NOT NULL GROUP BY 1",
    "pattern_merge_log": f"WITH {MERGE}, k AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY ord) AS k FROM m0), a AS (SELECT pattern, CASE WHEN norm IS NULL THEN 'FILTERED' WHEN k > 1 THEN 'MERGED → ' || norm WHEN norm <> pattern THEN 'RENAMED → ' || norm END AS action FROM k) SELECT * FROM a WHERE action IS NOT NULL",
    "lemma_validate": f"WITH {judged_lemmas('(SELECT lemma FROM lemma_cases)').replace('RECURSIVE ', 'RECURSIVE ' + cte('lemma_cases') + ', ', 1)} SELECT id, final AS lemma, status FROM lemma_cases c JOIN lem ON c.lemma IS NOT DISTINCT FROM lem.lemma",
    "lemma_counts": f"WITH {judged_lemmas('(SELECT head_lemma AS lemma FROM valid)').replace('RECURSIVE ', 'RECURSIVE ' + RAW + ', ', 1)} SELECT status, count(*) AS n, count(DISTINCT v.head_lemma) AS n_lemmas FROM valid v JOIN lem ON v.head_lemma = lem.lemma GROUP BY 1",
    "jaccard_sets": f"""WITH {cte('set_cases')}, t AS (SELECT id, list_distinct(list_filter(string_split(a, ','), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(b, ','), lambda x: x <> '')) AS b FROM set_cases)
        SELECT id, {r6("CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END", 'jaccard')} FROM t""",
    "asc_parse": f"WITH {numbered(HEADER, 'NOT failed')} SELECT doc_id, sent_idx, f[1]::INTEGER AS token_num, f[2] AS token, f[3] AS lemma, nullif(f[4], '') AS asc_tag FROM tokens",
    "asc_profile": f"WITH {LOOSE} SELECT f[4] AS asc_tag, count(*) AS n FROM tokens WHERE f[4] <> '' GROUP BY 1",
    "asc_totals": f"WITH {LOOSE} SELECT doc_id, max(sent_idx) AS total_sentences, count(*) AS total_tokens FROM tokens GROUP BY 1",
    "tree_constructions": f"WITH {TREES} SELECT doc_id, sent_idx, surface, tam, comp, subjtype, tam || ',' || comp AS pattern, head_lemma, subject_text, chain, following_word FROM built",
    "tree_complements": f"WITH {TREES} SELECT doc_id, sent_idx, head_lemma, by_text, CASE WHEN by_text IS NOT NULL THEN 'by' ELSE prep END AS prep_head, vp_text, coalesce(pp_all, '') AS pps FROM built",
    "passive_sentences": f"WITH {cte('tree_tokens')} SELECT doc_id, sent_idx, string_agg(token, ' ' ORDER BY token_num) AS text, count(*) FILTER (asc_tag = 'PASSIVE') AS n_tags FROM tree_tokens GROUP BY ALL HAVING count(*) FILTER (asc_tag = 'PASSIVE') > 0",
    "surface_chains": f"WITH {cte('surface_texts')}, documents AS (SELECT * FROM surface_texts), {RAW} SELECT row_id, surface, tam, comp, subjtype, pattern, head_lemma, subject_text, chain, following_word FROM raw",
    "tam_first_examples": f"WITH {RAW} SELECT tam, count(*) AS n, arg_min(row_id, (doc_id::BIGINT, sent_idx, pos)) AS row_id, arg_min(surface, (doc_id::BIGINT, sent_idx, pos)) AS surface FROM raw GROUP BY 1",
    "filtering_cascade": f"""WITH {PM}, n AS (SELECT (SELECT count(*) FROM raw) AS a, (SELECT count(*) FROM valid) AS b, (SELECT count(*) FROM kept) AS c, (SELECT count(*) FROM acc) AS d, (SELECT count(*) FILTER (accepted) FROM acc) AS e)
        SELECT 'total' AS stage, a AS n, 100.0::DOUBLE AS percent FROM n UNION ALL SELECT 'valid', b, round_even(b * 100.0::DOUBLE / a, 2) FROM n UNION ALL SELECT 'formulaic', c, round_even(c * 100.0::DOUBLE / b, 2) FROM n
        UNION ALL SELECT 'patterns', d, NULL FROM n UNION ALL SELECT 'accepted', e, round_even(e * 100.0::DOUBLE / d, 2) FROM n""",
    "schema_inventory": f"WITH {PM} SELECT pattern AS schema, n_tokens AS n, round_even(npmi, 4) AS npmi, round_even(h_slot, 4) AS h_slot, round_even(g_squared, 2) AS g_squared, round_even(atp, 4) AS atp, round_even(delta_p, 4) AS delta_p, lane FROM acc WHERE accepted",
    "exact_p_tpch": f"""WITH {TP}, x AS (SELECT pattern, sqrt(g_squared / 2) AS x FROM pm)
        SELECT pattern, {r6("CASE WHEN x <= 0 THEN 1.0 WHEN x > 6 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 200), lambda n: exp(2 * n * ln(2) + (2 * n + 1) * ln(x) - lgamma(2 * n + 2) + lgamma(n + 1) - x * x))) END", 'exact_p')} FROM x""",
    "corpus_csv": "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS md5 FROM documents WHERE text IS NOT NULL",
    "asc_folder": f"WITH {numbered(HEADER, 'NOT failed')}, t AS (SELECT doc_id, count(*) AS n_tokens, max(sent_idx) AS n_sentences FROM tokens GROUP BY 1), b AS (SELECT doc_id, bool_or(failed) AS failed FROM fine GROUP BY 1) SELECT a.doc_id, b.failed, n_tokens, n_sentences FROM asc_files a JOIN b USING (doc_id) LEFT JOIN t USING (doc_id) WHERE a.value <> ''",
    "instances_csv": f"WITH {SCORED} SELECT doc_id, surface, tam, comp, subjtype, head_lemma, pattern, subject_text, {r6('instance_atp')}, {r6('instance_dpb')}, {r6('instance_hr')}, true AS nothing_for_empty FROM scored",
    "instances_csv_missing": f"WITH {cte('instance_cases')} SELECT doc_id, coalesce(instance_atp, 0.0) AS instance_atp, coalesce(instance_dpb, 0.0) AS instance_dpb, coalesce(instance_hr, 'inf'::DOUBLE) = 'inf'::DOUBLE AS hr_is_inf, CASE WHEN instance_hr IS NULL THEN 999.0 WHEN instance_hr <> 'inf'::DOUBLE THEN instance_hr END AS hr_999 FROM instance_cases",
    "patterns_csv": f"WITH {TP} SELECT pattern, n_tokens, n_docs, {', '.join(map(r6, NUMBERS))}, row_number() OVER (ORDER BY n_tokens DESC, pattern)::INTEGER AS place FROM pm",
    "pattern_names": f"WITH {PARTS} SELECT DISTINCT pattern FROM parts",
    "inventory_csv": f"""WITH {PM}, i AS (SELECT pattern AS schema, n_tokens AS n, n_docs, {', '.join(map(r6, ('npmi', 'h_slot', 'g_squared', 'atp', 'delta_p')))}, coalesce(lane, '') AS lane, accepted FROM acc)
        SELECT 'patterns' AS file, * FROM i UNION ALL SELECT 'schemas', * REPLACE (NULL AS accepted) FROM i WHERE accepted""",
    "results_json": f"WITH {TP} SELECT 'patterns' AS part, pattern AS name, n_tokens AS n, {r6('npmi', 'x')} FROM pm UNION ALL SELECT 'docs', quality::VARCHAR, count(*), NULL FROM labels GROUP BY 2",
    "venn_json": f"WITH {MEMBERS}, v AS (SELECT pattern, CASE WHEN f AND n1 THEN 'both' WHEN f THEN 'FULL_only' ELSE 'NO_LAYER1_only' END AS part FROM has WHERE f OR n1) SELECT part, count(*) AS n, string_agg(pattern, '|' ORDER BY pattern) AS patterns FROM v GROUP BY 1",
    "list_file": "SELECT l.doc_id::VARCHAR AS doc_id, d.doc_id IS NOT NULL AS found, length(d.text) AS n_chars FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id UNION ALL SELECT 'absent', false, NULL",
    "summary_profile": f"""WITH {cte('tagger_summary')}, m AS (SELECT 'clauseCount' AS metric, try_cast(clauseCount AS DOUBLE) AS x FROM tagger_summary UNION ALL SELECT 'clauseCountNoBe', try_cast(clauseCountNoBe AS DOUBLE) FROM tagger_summary UNION ALL SELECT 'PASSIVE_Prop', try_cast(PASSIVE_Prop AS DOUBLE) FROM tagger_summary),
        s AS (SELECT metric, count(*) AS n, min(x) AS a, max(x) AS b, avg(x) AS c FROM m WHERE x IS NOT NULL GROUP BY 1)
        SELECT 'filename|nwords|PASSIVE_freq|clauseCount|clauseCountNoBe|passive_Rate|PASSIVE_Prop' AS columns, 7 AS num_columns, (SELECT count(*) FROM tagger_summary) AS num_rows, 'PASSIVE_freq|passive_Rate|PASSIVE_Prop' AS passive_columns,
        (SELECT string_agg(metric || ' ' || n || ' ' || printf('%.4f', a) || ' ' || printf('%.4f', b) || ' ' || printf('%.4f', c), '; ' ORDER BY metric) FROM s) AS stats, (SELECT string_agg(filename, '|' ORDER BY filename) FROM (SELECT filename FROM tagger_summary ORDER BY filename LIMIT 3)) AS sample_rows""",
    "resume_anti_join": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "listed_documents": "SELECT l.doc_id, d.doc_id IS NOT NULL AS found, length(d.text) AS n_chars FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id",
    "metric_profile": f"WITH m AS (SELECT 'user_id' AS metric, user_id::DOUBLE AS x FROM events UNION ALL SELECT 'value', value FROM events UNION ALL SELECT 'event_type', try_cast(event_type AS DOUBLE) FROM events) SELECT metric, count(*) AS n, {r6('min(x)', 'least')}, {r6('max(x)', 'largest')}, {r6('avg(x)', 'mean')} FROM m WHERE x IS NOT NULL GROUP BY 1",
}
