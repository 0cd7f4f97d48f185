"""What source text says: facts of methods, transactions, accesses, guards, and graphs with what their handlers' code adds."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import augment
from ..operators.code import FACT, Facts
from ..sources import projects
from ..sources.corpus import once
from ..sources.syntax import syntax
from .base import add

CONTROLLERS = "path like 'app/Http/Controllers/%'"


def code(spark, sf_dir):
    """The facts of the derived projects; their tables are written once a session."""
    keep = once(spark, "code", sf_dir, ("part",))
    files = projects.project_files(spark, sf_dir)
    return Facts(keep(syntax(files), "syntax"), keep), keep, files


def passes(spark, sf_dir):
    facts, keep, files = code(spark, sf_dir)
    sinks = spark.range(1).select(F.explode(F.array(*map(F.lit, projects.SINKS))).alias("symbol"))
    return augment.Passes(facts, sinks, keep=keep), projects.entries(spark, sf_dir), files


def _listed(columns: str, rows: list[tuple], key: str = "k AS graph_id", numbered: str = "") -> str:
    """SQL of rows that each part has, where their condition holds; {k} in a text is the part's key."""
    names = columns.split(", ")
    text = lambda v: "NULL::VARCHAR" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "replace('" + v.replace("'", "''") + "', '{k}', k::VARCHAR)" if "{k}" in v else "'" + v.replace("'", "''") + "'"
    made = ", ".join("{'seq': " + str(i) + ", 'ok': " + cond + ", " + ", ".join(f"'{n}': {text(v)}" for n, v in zip(names, row)) + "}" for i, (cond, *row) in enumerate(rows))
    order = f", row_number() OVER (PARTITION BY k, {numbered} ORDER BY seq) - 1 AS ord" if numbered else ""
    return f"""SELECT {key}, {columns}{order} FROM (SELECT k, project, r.* FROM (SELECT p_partkey AS k, p_brand AS project, unnest([{made}]) AS r FROM part)) WHERE ok"""


_C = "project, 'app/Http/Controllers/P' || k || 'Controller.php' AS path"
_ITEM, _STOCK, _PRICE = r"App\Models\Item{k}", r"App\Services\StockService", r"App\Services\PriceService"
_FACTS = [
    ("true", "__construct", "constructor_middleware", "auth:web", "index", "", ""), ("k % 4 = 0", "__construct", "constructor_middleware", "permission:EDIT|VIEW", "", "store,index", ""),
    ("true", "index", "model_param", "Trail", r"App\Services\AuditTrail", "$trail", ""), ("true", "store", "form_request", "SaveRequest", r"App\Http\Requests\P{k}Request", "$request", ""), ("true", "store", "model_param", "Item{k}", _ITEM, "$item", ""),
    ("k % 2 = 0", "store", "authorize", "update", "$this->authorize('update', $item)", "$item", ""), ("k % 3 = 0", "store", "authorize", "publish", "Gate::allows('publish', $request)", None, ""), ("k % 7 = 0", "store", "authorize", "prepare", "$this->authorize('prepare', $item)", "$item", ""),
    ("true", "prepare", "authorize", "prepare", "$this->authorize('prepare', $item)", None, ""), ("true", "prepare", "service_call", "price", _PRICE, "warm", ""),
    ("true", "store", "service_call", "price", _PRICE, "quote", "a,b)"), ("k % 2 = 1", "store", "service_call", "item", _ITEM, "save", ""), ("true", "store", "service_call", "price", _PRICE, "apply", "x"), ("true", "store", "service_call", "stock", _STOCK, "settle", ""),
    ("true", "store", "service_call", "item", _ITEM, "tags()->delete", ""), ("k % 4 = 1", "store", "service_call", "item", _ITEM, "notify", ""), ("true", "store", "service_call", "stock", _STOCK, "report", ""), ("k % 7 = 0", "store", "service_call", "price", _PRICE, "warm", ""),
    ("k % 2 = 0", "store", "dispatch", "Ship{k}", r"App\Jobs\Ship{k}", "job", ""), ("k % 2 = 1", "store", "dispatch", "Shipped{k}", r"App\Events\Shipped{k}", "event", ""),
    ("k % 4 = 1", "store", "notification", "Told{k}", "Told{k}", "notification", ""), ("k % 4 = 2", "store", "notification", "Sent{k}", "Sent{k}", "queued", ""),
    ("k % 5 = 0", "store", "self_guard", "ensureOpen", "$item->closed()", None, ""), ("true", "store", "branch", "!empty($mode)", "mode", None, ""), ("true", "store", "branch_then", "stock", _STOCK, "fast", "now"), ("true", "store", "branch_else", "stock", _STOCK, "slow", ""),
]


@add("S03_controller_facts", _listed("method, kind, a, b, c, args", _FACTS, _C, "method, kind"))
def controller_facts(spark, d):
    facts, keep, _ = code(spark, d)
    return keep(facts.all(), "facts").where(CONTROLLERS).select(*FACT[:-1], F.array_join("args", ",").alias("args"))


_HELD = [
    ("true", "write", "Item{k}::create"), ("k % 2 = 1", "write", "unknown::save"), ("k % 3 = 0", "escape", "ItemCreated{k}"),
    ("true", "nested", "price/apply"), ("true", "nested", "stock/settle"),
]


@add("S06_transactions", _listed("kind, name", _HELD, _C + ", 'store' AS method, 0 AS block", "kind"))
def transactions(spark, d):
    return passes(spark, d)[0].held.where(CONTROLLERS).select("project", "path", "method", "block", "kind", "name", "ord")


@add("S07_dispatch_kinds", """WITH n AS (SELECT p_partkey AS k, p_type AS t FROM part), x AS (SELECT k, CASE k % 8 WHEN 0 THEN 'App\\Jobs\\OrderCreated' WHEN 1 THEN 'App\\Events\\SendMail' WHEN 2 THEN 'App\\Actions\\X' WHEN 3 THEN 'OrderCreated' WHEN 4 THEN 'WasSent' WHEN 5 THEN 'SendMail' WHEN 6 THEN 'App\\Other\\HandleIt' ELSE 'wasted' END || t AS name FROM n)
SELECT k, name, CASE k % 8 WHEN 0 THEN 'job' WHEN 1 THEN 'event' WHEN 2 THEN 'job' WHEN 3 THEN 'event' WHEN 4 THEN 'event' WHEN 5 THEN 'job' WHEN 6 THEN 'job' ELSE 'unknown' END AS kind FROM x""")
def dispatch_kinds(spark, d):
    from ..operators.code import dispatch_kind
    names = (r"App\Jobs\OrderCreated", r"App\Events\SendMail", r"App\Actions\X", "OrderCreated", "WasSent", "SendMail", r"App\Other\HandleIt", "wasted")
    x = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("k"), F.concat(F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % 8).cast("int")), "p_type").alias("name"))
    return x.withColumn("kind", dispatch_kind(F.col("name")))


_ACCESS = [("true", "index", "read", "Item{k}", "get", False), ("true", "store", "write", "Item{k}", "create", True), ("k % 2 = 1", "store", "write", "$item", "save", False)]


@add("S08_model_access", f"""SELECT x.*, method = 'index' AND k % 3 = 0 AS from_container FROM ({_listed("method, kind, model, operation, constrained", _ACCESS, _C + ", k", "method, kind")}) x""".replace("SELECT x.*", "SELECT x.* EXCLUDE (k)"))
def model_access(spark, d):
    p = passes(spark, d)[0]
    a = p.accesses.where(CONTROLLERS).join(p.tenants.withColumn("from_container", F.lit(True)), ["project", "path", "method"], "left")
    return a.select("project", "path", "method", "kind", "model", "operation", "constrained", "ord", F.coalesce("from_container", F.lit(False)).alias("from_container"))


@add("S09_guards", """SELECT p_brand AS project, 'app/Http/Controllers/P' || p_partkey || 'Controller.php' AS path, 'ensureOpen' AS method, 'leading_if_throw' AS reason, '$item->closed()' AS condition FROM part
UNION ALL SELECT DISTINCT p_brand, 'app/Services/StockService.php', 'assertOpen', 'guard_naming_with_throw', '$a' FROM part UNION ALL SELECT DISTINCT p_brand, 'app/Services/StockService.php', 'report', 'leading_if_throw', '!$item' FROM part""")
def guard_clauses(spark, d):
    return code(spark, d)[0].guards.select("project", "path", "method", "reason", "condition")


@add("S10_audits", """SELECT DISTINCT p_brand AS project, 'app/Services/LedgerService.php' AS path, 'book' AS method, 0 AS ord, 'activity()->log' AS symbol, 'book' AS args FROM part
UNION ALL SELECT DISTINCT p_brand, 'app/Services/StockService.php', 'fast', 0, 'Activity::add', 'fast,x' FROM part""")
def audit_calls(spark, d):
    return passes(spark, d)[0].audits.select("project", "path", "method", "ord", "symbol", F.array_join("args", ",").alias("args"))


_ON, _P = "k % 3 = 0", "app/Policies/P{k}Policy.php"
_S, _R = "app/Services/StockService.php", "app/Services/PriceService.php"
_UPDATE = "k % 2 = 0 AND k % 3 <> 0"
_NODES = [
    ("true", "fr_saverequest", "ir:validation_gate", "SaveRequest::authorize", "validation", "app/Http/Requests/P{k}Request.php", None, ""),
    ("k % 2 = 0", "policy_p{k}policy_update", "ir:authz_check", "P{k}Policy::update", "authorization", _P, None, ""), (_ON, "policy_p{k}policy_publish", "ir:authz_check", "P{k}Policy::publish", "authorization", _P, None, ""), ("k % 7 = 0", "policy_p{k}policy_prepare", "ir:authz_check", "P{k}Policy::prepare", "authorization", _P, None, ""),
    (_UPDATE, "svc_stockservice_owns_policy_p{k}policy_update", "ir:service_call", "StockService::owns", "service", _S, None, "it"),
    ("true", "resource_item{k}_handler", "ir:resource", "Item{k}", "accessed_resource", None, None, ""), ("k % 2 = 0", "job_ship{k}_handler", "ir:queue_job", "Ship{k}::dispatch", "async_execution", "app/Jobs/Ship{k}.php", None, ""), ("k % 2 = 1", "evt_shipped{k}_handler", "ir:event_dispatch", "Shipped{k}::dispatch", "event_emission", None, None, ""),
    ("k % 4 = 1", "notif_told{k}_handler", "ir:notification", "Told{k}::via", "side_effect", None, '{"className":"Told{k}","queued":false}', ""), ("k % 4 = 2", "mail_sent{k}_handler", "ir:mail", "Sent{k}::build", "side_effect", None, '{"className":"Sent{k}","queued":true}', ""),
    ("true", "ctor_mw_0_auth_web", "ir:auth_gate", "auth:web", "authentication", None, None, ""), ("k % 4 = 0", "ctor_mw_1_permission_edit_view", "ir:authz_check", "permission:EDIT|VIEW", "authorization", None, None, "EDIT,VIEW"),
    ("true", "svc_priceservice_quote_handler", "ir:service_call", "PriceService::quote", "service", _R, None, "a,b)"), ("k % 2 = 1", "svc_item{k}_save_handler", "ir:service_call", "Item{k}::save", "service", "app/Models/Item{k}.php", None, ""),
    ("true", "svc_priceservice_apply_handler", "ir:service_call", "PriceService::apply", "service", _R, None, "x"), ("true", "svc_stockservice_settle_handler", "ir:service_call", "StockService::settle", "service", _S, None, ""),
    ("true", "svc_item{k}_tags____delete_handler", "ir:service_call", "Item{k}::tags()->delete", "service", "app/Models/Item{k}.php", None, ""), ("k % 4 = 1", "svc_item{k}_notify_handler", "ir:service_call", "Item{k}::notify", "service", "app/Models/Item{k}.php", None, ""),
    ("true", "svc_stockservice_report_handler", "ir:guard_clause", "StockService::report", "guard", _S, "!$item", ""), ("k % 7 = 0", "svc_priceservice_warm_handler", "ir:service_call", "PriceService::warm", "service", _R, None, ""),
    ("true", "branch_handler_0", "ir:conditional_branch", "!empty($mode)", "control_flow", None, "mode", ""), ("true", "svc_stockservice_fast_branch_handler_0", "ir:service_call", "StockService::fast", "service", _S, None, "now"), ("true", "svc_stockservice_slow_branch_handler_0", "ir:service_call", "StockService::slow", "service", _S, None, ""),
    ("k % 5 = 0", "guard_handler_0", "ir:guard_clause", "P{k}Controller::ensureOpen", "guard", "app/Http/Controllers/P{k}Controller.php", "$item->closed()", ""),
    ("true", "txn_handler_0", "ir:txn_boundary", "DB::transaction", "atomicity", None, None, ""), ("true", "txn_write_handler_0_0", "ir:txn_write", "Item{k}::create", "persistence", None, None, ""), ("k % 2 = 1", "txn_write_handler_0_1", "ir:txn_write", "unknown::save", "persistence", None, None, ""), (_ON, "txn_escape_handler_0_0", "ir:txn_escape", "ItemCreated{k}::dispatch", "side_effect", None, None, ""),
    ("k % 2 = 1", "iso_write_handler_1", "ir:unscoped_write", "$item::save", "data_access", None, None, ""),
]


@add("S02_augmented_nodes", f"""SELECT * REPLACE (CASE WHEN id = 'fr_saverequest' AND graph_id % 2 = 0 THEN '$this->user()?->owns(' || graph_id || ')' ELSE detail END AS detail) FROM ({_listed("id, type, symbol, role, file, detail, args", _NODES)})""")
def augmented_nodes(spark, d):
    p, entries, files = passes(spark, d)
    return augment.augment(entries, p, files).nodes.select("graph_id", "id", "type", "symbol", "role", "file", "detail", F.array_join(F.coalesce("args", F.array().cast("array<string>")), ",").alias("args"))


_SERVICES = [(c, i) for c, i, t, *_ in _NODES if i.startswith("svc_") and i.endswith("_handler")]
_AFTER = [x for x in _SERVICES if "warm" in x[1]]
_WRAPS = [("true", "txn_handler_0", "txn_write_handler_0_0", "ir:wraps", "static", None), ("k % 2 = 1", "txn_handler_0", "txn_write_handler_0_1", "ir:wraps", "static", None), (_ON, "txn_handler_0", "txn_escape_handler_0_0", "ir:wraps", "static", None), ("true", "txn_handler_0", "svc_priceservice_apply_handler", "ir:wraps", "semantic", None), ("true", "txn_handler_0", "svc_stockservice_settle_handler", "ir:wraps", "semantic", None)]
_EDGES = [
    ("true", "handler", "fr_saverequest", "form_request", "static", None),
    *((c, "handler", f"policy_p{{k}}policy_{a}", "policy_check", "semantic", m) for c, a, m in (("k % 2 = 0", "update", "$this->authorize('update', $item)"), (_ON, "publish", "Gate::allows('publish', $request)"), ("k % 7 = 0", "prepare", "$this->authorize('prepare', $item)"))),
    (_UPDATE, "policy_p{k}policy_update", "svc_stockservice_owns_policy_p{k}policy_update", "calls", "semantic", None), ("true", "handler", "resource_item{k}_handler", "ir:accesses", "static", None),
    ("k % 2 = 0", "policy_p{k}policy_update", "resource_item{k}_handler", "ir:authorizes", "semantic", "$this->authorize('update', $item)"), ("k % 7 = 0", "policy_p{k}policy_prepare", "resource_item{k}_handler", "ir:authorizes", "semantic", "$this->authorize('prepare', $item)"),
    ("k % 2 = 0", "handler", "job_ship{k}_handler", "ir:dispatches", "static", None), ("k % 2 = 1", "handler", "evt_shipped{k}_handler", "ir:dispatches", "static", None), ("k % 4 = 1", "handler", "notif_told{k}_handler", "ir:sends", "static", None), ("k % 4 = 2", "handler", "mail_sent{k}_handler", "ir:sends", "static", None),
    ("true", "ctor_mw_0_auth_web", "handler", "next_middleware", "static", None), ("k % 4 = 0", "ctor_mw_1_permission_edit_view", "handler", "next_middleware", "static", None),
    *((c, "handler", i, "calls", "semantic", None) for c, i in _SERVICES), *((c, "svc_stockservice_report_handler", i, "ir:guards", "semantic", None) for c, i in _AFTER), *((f"{c} AND k % 5 = 0", "guard_handler_0", i, "ir:guards", "semantic", None) for c, i in _SERVICES),
    ("true", "handler", "branch_handler_0", "calls", "static", None), *(("true", "branch_handler_0", f"svc_stockservice_{x}_branch_handler_0", r, "semantic", None) for x in ("fast", "slow") for r in ("calls", "ir:controls")), ("k % 5 = 0", "handler", "guard_handler_0", "calls", "semantic", None),
    ("true", "handler", "txn_handler_0", "opens_transaction", "static", None), *_WRAPS, (_ON, "txn_escape_handler_0_0", "txn_handler_0", "escapes_transaction", "static", None), ("k % 2 = 1", "handler", "iso_write_handler_1", "calls", "static", None),
]


@add("S02_augmented_edges", _listed("src, dst, relation, traceability, mechanism", _EDGES))
def augmented_edges(spark, d):
    p, entries, files = passes(spark, d)
    return augment.augment(entries, p, files).edges.select("graph_id", "src", "dst", "relation", "traceability", "mechanism")


@add("S02_missing_policies", _listed("node, description", [(f"k % 3 = 0 AND {c}", f"policy_p{{k}}policy_{a}", "P{k}Policy referenced in P{k}Controller::store but class file not found at app/Policies/P{k}Policy.php") for c, a in (("k % 2 = 0", "update"), ("k % 3 = 0", "publish"), ("k % 7 = 0", "prepare"))]))
def missing_policies(spark, d):
    p, entries, files = passes(spark, d)
    return p.missing_policies(entries, files).select("graph_id", "node", "description")


@add("J15_wraps_edges", _listed("src, dst, relation, traceability", [x[:-1] for x in _WRAPS]))
def wraps_edges(spark, d):
    p, entries, _ = passes(spark, d)
    edges = p.transactions(entries, p.services(entries))[1]
    return augment._all(edges).where("relation = 'ir:wraps'").select("graph_id", "src", "dst", "relation", "traceability")


_VISITS = [  # in line: condition, path, method, cost
    ("true", _R, "quote", 0), ("k % 2 = 1", "app/Models/Item{k}.php", "save", 0), ("true", _R, "apply", 0), ("true", _S, "settle", 3), ("true", "app/Models/Item{k}.php", "tags()->delete", 0), ("k % 4 = 1", "app/Models/Item{k}.php", "notify", 0), ("true", _S, "report", 0), ("k % 7 = 0", _R, "warm", 0), (_UPDATE, _S, "owns", 1),
]


def _visited(budget: int) -> str:
    first = _listed("path, method, cost", _VISITS, "k AS graph_id, seq").replace("SELECT k AS graph_id, seq", "SELECT k AS graph_id, seq", 1)
    return f"""WITH a AS ({first}), l1 AS (SELECT *, {budget} - coalesce(sum(cost) OVER (PARTITION BY graph_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM a),
v1 AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY seq) AS nth FROM l1 WHERE left_ > 0), r AS (SELECT graph_id, {budget} - sum(cost) AS rest FROM v1 GROUP BY 1),
b AS (SELECT graph_id, rest, nth, 'app/Services/LedgerService.php' AS path, CASE method WHEN 'settle' THEN 'close' ELSE 'owns' END AS method, 1 AS cost FROM v1 JOIN r USING (graph_id) WHERE method IN ('settle', 'owns')),
l2 AS (SELECT *, rest - coalesce(sum(cost) OVER (PARTITION BY graph_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM b)
SELECT graph_id, 1 AS level, nth, path, method, cost, left_ AS "left" FROM v1
UNION ALL SELECT graph_id, 2, row_number() OVER (PARTITION BY graph_id ORDER BY nth), path, method, cost, left_ FROM l2 WHERE left_ > 0"""


def _expand(spark, d, budget):
    p, entries, _ = passes(spark, d)
    keep = once(spark, f"expansion-{budget}", d, ("part",))
    return augment.expanded(augment.roots(entries, p), p, budget=budget, keep=keep)


@add("R19_expanded", _visited(50))
def visits(spark, d):
    return _expand(spark, d, 50)[2]


@add("R19_small_budget", _visited(4))
def scarce_visits(spark, d):
    return _expand(spark, d, 4)[2]


_LEFT = "app/Services/StockService.php"
_GROWN = [
    ("true", "guard_svc_stockservice_settle_handler_0", "ir:guard_clause", "StockService::assertOpen"), ("true", "iso_query_svc_stockservice_settle_handler_0", "ir:unscoped_query", "Stock::all"), ("true", "iso_write_svc_stockservice_settle_handler_0", "ir:unscoped_write", "$s::save"),
    ("true", "svc_ledgerservice_close_svc_stockservice_settle_handler", "ir:service_call", "LedgerService::close"), ("true", "tenant_injection_svc_stockservice_report_handler", "ir:runtime_inject", "app()->instance('tenant', $tenant)"),
    (_UPDATE, "svc_ledgerservice_owns_svc_stockservice_owns_policy_p{k}policy_update", "ir:service_call", "LedgerService::owns"),
    ("true", "iso_query_svc_ledgerservice_close_svc_stockservice_settle_handler_0", "ir:unscoped_query", "Entry::paginate"),
    (_UPDATE, "iso_query_svc_ledgerservice_owns_svc_stockservice_owns_policy_p{k}policy_update_0", "ir:unscoped_query", "Entry::find"),
]


@add("R19_expanded_nodes", _listed("id, type, symbol", _GROWN))
def expanded_nodes(spark, d):
    return _expand(spark, d, 50)[0].select("graph_id", "id", "type", "symbol")
