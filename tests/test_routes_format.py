"""The data source of routes: shares of files, predicates at the scan, cases without rows."""
import pytest

from graphmill.sources import routes_format, scan
from graphmill.sources.routes_format import RoutesReader, Share

PHP = "Route::get('/a', [A::class, 'x'])->middleware('auth'); Route::post('/b', 'B@y');"
NEST = "@Controller('c') export class C { @Get() list() {} }"


@pytest.fixture
def tree(tmp_path):
    for name, text in {"routes/web.php": PHP, "routes/empty.php": "", "src/c.ts": NEST, "src/c.d.ts": NEST, "readme.md": PHP, "_hidden.php": PHP}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    return tmp_path


def test_a_tree_of_files(spark, tree):
    routes_format.register(spark)
    df = spark.read.format("routes").option("project", "p").option("partition_bytes", "1").load(f"file://{tree}")
    assert sorted((r.framework, r.project, r.file, r.nth, r.method, r.path, r.handler, [g.symbol for g in r.gates]) for r in df.collect()) == [
        ("laravel", "p", "routes/web.php", 0, "GET", "/a", "A::x", ["auth"]), ("laravel", "p", "routes/web.php", 1, "POST", "/b", "B::y", []), ("nestjs", "p", "src/c.ts", 0, "GET", "/c", "C::list", [])]
    assert df.where("method = 'POST'").count() == 1 and df.where("file like '%.ts' and framework = 'nestjs'").count() == 1
    assert df.where("project = 'q'").count() == 0 and df.where("project is null").count() == 0
    assert spark.read.format("routes").load(f"file://{tree}/none").count() == 0


def test_predicates_reach_the_scan_and_files_that_cannot_answer_are_not_read(spark, tree):
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringStartsWith
    reader = RoutesReader(str(tree), "p", 1 << 20)
    left = list(reader.pushFilters([EqualTo(("framework",), "laravel"), StringStartsWith(("file",), "routes/w"), EqualTo(("path",), "/a"), GreaterThan(("nth",), 0)]))
    assert [f.attribute for f in left] == [("path",), ("nth",)]
    assert [[f.rsplit("/", 1)[-1] for f in s.files] for s in reader.partitions()] == [["web.php"]]
    plan = spark.read.format("routes").load(f"file://{tree}").where("framework = 'nestjs' and path = '/c'")._jdf.queryExecution().toString()
    after = [x for x in plan.split("== Physical Plan ==")[1].splitlines() if " Filter " in x]
    assert after and all("path" in x and "framework" not in x for x in after)


def test_tables_of_files_are_shared_by_row_groups(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    n = 5_000
    pq.write_table(pa.table({"project": [None if k % 7 == 0 else f"p{k % 3}" for k in range(n)], "path": [None if k == 9 else f"r/{k}.php" for k in range(n)], "content": [None if k % 11 == 0 else f"Route::get('/{k}', 'A@b');" for k in range(n)]}), tmp_path / "files.parquet", row_group_size=700)
    want = sorted(f"/{k}" for k in range(n) if k != 9 and k % 11)
    for most in ("100", "10000000"):
        df = spark.read.format("routes").option("partition_bytes", most).load(str(tmp_path))
        assert sorted(r.path for r in df.select("path").collect()) == want
        assert df.where("project = 'p1'").count() == sum(k % 7 > 0 and k % 3 == 1 and k % 11 > 0 and k != 9 for k in range(n))
    shares = RoutesReader(str(tmp_path), "", 100).partitions()
    assert len(shares) > 1 and all(isinstance(s, Share) and s.of == len(shares) for s in shares)


def test_security_annotations_keep_their_words():
    text = '@RestController @PreAuthorize("isAuthenticated()") class A { @GetMapping("/x") @Secured({"A", "B"}) public void a() {} @PostMapping @PreAuthorize("hasRole(\'X\') and !isAnonymous()") @RequiresRoles("q") public void b() {} }'
    got = [(m, p, g) for m, p, g, _ in scan.ADAPTERS["springboot"](text)]
    login = ("ir:auth_gate", "PreAuthorize", ["isAuthenticated()"])
    assert got == [("GET", "/x", [login, ("ir:authz_check", "Secured", ["A", "B"])]), ("POST", "/", [login, ("ir:authz_check", "PreAuthorize", ["hasRole('X') and !isAnonymous()"]), ("ir:unknown_middleware", "RequiresRoles", ["q"])])]
    assert scan.implied(got[0][2], "springboot") == [login, ("ir:auth_gate", "isAuthenticated()", []), ("ir:authz_check", "Secured", ["A", "B"])]
    assert scan.implied(got[0][2], "nestjs") == got[0][2]
