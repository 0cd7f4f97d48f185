"""Source readers and project joins on small examples."""
from pyspark.sql import functions as F

from graphmill.operators import project
from graphmill.sources import scan
from graphmill.sources.corpus import from_nested

LARAVEL = """<?php // Route::get('/no', 'X@y');
Route::get('/home', [HomeController::class, 'show'])->middleware('auth:sanctum');
Route::prefix('api')->middleware(['auth', 'throttle:60,1'])->group(function () {
    Route::post('tasks/{task}', 'TaskController@store')->middleware('can:update,task');
    Route::controller(OrderController::class)->group(function () { Route::match(['get', 'post'], 'orders', 'all'); });
    Route::apiResource('users', UserController::class)->except(['destroy']);
});
"""
NEST = """@Controller('cats') @UseGuards(JwtAuthGuard)
export class CatsController {
  @Public() @Get() list() { return []; }
  @Post(':id')
  @UseGuards(RolesGuard)
  async save(@Param('id') id: string) {}
}"""
SPRING = """@RestController
@RequestMapping("/api")
public class BookController {
  @GetMapping("/books/{id}")
  @PreAuthorize("hasRole('ADMIN')")
  public Book one(@PathVariable Long id) { return null; }
  @DeleteMapping
  public void drop() {}
}"""
GIN = """r := gin.Default()
r.Use(Logger())
v1 := r.Group("/v1", AuthMiddleware())
v1.GET("/items/:id", RequirePermission("read"), items.Show)
r.POST("/login", Login)"""


def found(name, text):
    return [(m, p, [(k, s) for k, s, _ in gates], h) for m, p, gates, h in scan.ADAPTERS[name](text)]


def test_laravel():
    auth, slow = ("ir:auth_gate", "auth"), ("rate_limiter", "throttle")
    assert found("laravel", LARAVEL) == [
        ("GET", "/home", [auth], "HomeController::show"),
        ("POST", "/api/tasks/{task}", [auth, slow, ("ir:authz_check", "can")], "TaskController::store"),
        ("GET", "/api/orders", [auth, slow], "OrderController::all"), ("POST", "/api/orders", [auth, slow], "OrderController::all"),
        *((m, "/api/users" + tail, [auth, slow], f"UserController::{a}") for a, m, tail in scan.RESOURCE if a not in ("create", "edit", "destroy"))]


def test_others():
    assert found("nestjs", NEST) == [("GET", "/cats", [], "CatsController::list"), ("POST", "/cats/:id", [("ir:auth_gate", "JwtAuthGuard"), ("ir:authz_check", "RolesGuard")], "CatsController::save")]
    assert found("springboot", SPRING) == [("GET", "/api/books/{id}", [("ir:authz_check", "PreAuthorize")], "BookController::one"), ("DELETE", "/api", [], "BookController::drop")]
    assert found("go", GIN) == [("GET", "/v1/items/{id}", [("ir:unknown_middleware", "Logger"), ("ir:auth_gate", "AuthMiddleware"), ("ir:authz_check", "RequirePermission")], "items::Show"), ("POST", "/login", [("ir:unknown_middleware", "Logger")], "Login")]
    assert all(list(f("")) == [] and list(f("((('{")) == [] for f in scan.ADAPTERS.values())


def test_files_become_graphs(spark, tmp_path):
    (tmp_path / "web.php").write_text(LARAVEL)
    (tmp_path / "empty.php").write_text("")
    files = scan.read_files(spark, f"file://{tmp_path}", "*.php")
    c = from_nested(scan.routes(files, "laravel"))
    assert c.graphs.count() == 9 and c.nodes.where("ir_type = 'ir:business_handler'").count() == 9
    assert c.graphs.select("graph_id").distinct().count() == 9 and c.edges.where("relation = 'next_middleware'").count() == c.nodes.count() - 9
    seen = files.select("path", "key")
    assert scan.changed(files, seen).count() == 0 and scan.changed(files, seen.where("path like '%empty%'")).count() == 1


def test_schedules_and_dispatches(spark):
    text = "$schedule->command('mail:send')->daily(); $schedule->job(new Prune)->cron('5 * * * *'); $schedule->command('x')->withoutOverlapping();"
    got = scan.schedules(spark.createDataFrame([("k", text)], "path string, content string")).collect()
    assert [(r.symbol, r.cron) for r in got] == [("mail:send", "0 0 * * *"), ("Prune", "5 * * * *")]
    names = spark.createDataFrame([(r"App\Events\Job",), ("SendMailJob",), ("UserCreated",), ("Thing",)], "name string")
    assert [r[0] for r in names.select(scan.dispatch_kind(F.col("name"))).collect()] == ["event", "job", "event", "unknown"]


def test_project_joins(spark):
    t = spark.createDataFrame
    routes = t([(1, "m", "/api/x/1"), (2, "m", "/open"), (3, "n", "/api")], "route_id long, module string, path string")
    rules = t([("m", 1, "/**", "authenticated"), ("m", 2, "/api/**", "admin"), ("m", 3, "/api/x/{id}", "owner")], "module string, rule_ord int, pattern string, access string")
    assert {r.route_id: r.access for r in project.secured(routes, rules).collect()} == {1: "owner", 2: "authenticated", 3: None}
    calls = t([(1, "S", "a"), (2, "I", "a"), (3, "Z", "a")], "call_id long, class string, method string")
    got = project.transactional(calls, t([("S", "a", "REQUIRED")], "class string, method string, propagation string"), t([("I", "S")], "interface string, class string"))
    assert {r.call_id: r.propagation for r in got.collect()} == {1: "REQUIRED", 2: "REQUIRED", 3: None}
    r = t([("GET", "/a"), ("POST", "/a"), ("GET", "/b")], "method string, path string")
    assert sorted(map(tuple, project.not_exempt(r, t([("GET", "/a"), ("*", "/b")], "method string, path string")).collect())) == [("POST", "/a")]
    e = project.listened(t([(1, "E"), (1, "F")], "graph_id long, event string"), t([("E", "L", True), ("E", "M", False)], "event string, listener string, after_commit boolean"))
    assert sorted((x.event, x.listener) for x in e.where("listener is not null").collect()) == [("E", "L"), ("E", "M")] and e.count() == 3
    assert [tuple(x) for x in project.hierarchy(t([(1, "EDIT"), (1, "EDIT_ANY"), (2, "EDIT_ANY")], "graph_id long, symbol string")).collect()] == [(1, "EDIT_ANY", "EDIT")]
    p = t([(1, "Perm", "x"), (1, "Other", "y"), (2, "Perm", "x")], "graph_id long, class string, value string")
    s = project.sources_of(t([(1, "f"), (1, "f")], "graph_id long, file string"), t([("f", "use Perm;")], "file string, content string"))
    assert sorted(map(tuple, project.reachable_permissions(p, s, t([(2, "x")], "graph_id long, value string")).collect())) == [(1, "Perm", "x"), (2, "Perm", "x")]
    n = t([(1, 1, "a"), (1, 2, "ir:guard_clause"), (1, 3, "b")], "graph_id long, node_ord long, type string")
    assert [tuple(x) for x in project.guarded(n).collect()] == [(1, 2, 3)]
