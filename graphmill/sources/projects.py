"""Source files of web projects, derived from ``part``: a project a brand, a controller with what belongs to it a part.

As with the derived graphs, what a file says depends on the part's key alone, so that SQL can tell what readers must find.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: lines of a part's controller, with the condition under which each stands; {k} is the part's key
CONTROLLER = (
    ("true", r"<?php"), ("true", r"namespace App\Http\Controllers;"), ("true", r"use App\Models\Item{k};"), ("true", r"use App\Services\StockService;"),
    ("true", r"use App\Services\{PriceService, AuditTrail as Trail};"), ("true", r"use App\Http\Requests\P{k}Request as SaveRequest;"), ("k % 2 = 0", r"use App\Jobs\Ship{k};"), ("k % 2 = 1", r"use App\Events\Shipped{k};"),
    ("true", r"class P{k}Controller extends Controller"), ("true", r"{"),
    ("true", r"    public function __construct(private StockService $stock, protected ?PriceService $price)"), ("true", r"    {"),
    ("true", r"        $this->middleware('auth:web', ['except' => ['index']]);"), ("k % 4 = 0", r"        $this->middleware('permission:EDIT|VIEW', ['only' => ['store', 'index']]);"), ("true", r"    }"),
    ("true", r"    public function index(Trail $trail)"), ("true", r"    {"), ("k % 3 = 0", r"        $t = app('tenant');"),
    ("true", r"        return Item{k}::where('a', fn ($q) => Other::find(1))->orderBy('x')->get();"), ("true", r"    }"),
    ("true", r"    public function store(SaveRequest $request, Item{k} $item)"), ("true", r"    {"),
    ("k % 5 = 0", r"        $this->ensureOpen($item);"), ("k % 7 = 0", r"        $this->prepare($item);"), ("true", r"        // $this->authorize('never', $item);"),
    ("k % 2 = 0", r"        $this->authorize('update', $item);"), ("k % 3 = 0", r"        Gate::allows('publish', $request);"),
    ("true", r"        $mode = $request->input('mode');"), ("true", r"        if (!empty($mode)) { $this->stock->fast('now', $mode); } else { $this->stock->slow(); }"),
    ("true", "        $this->price->quote('a', \"b)\");"), ("true", r"        DB::transaction(function () use ($item) {"), ("true", r"            Item{k}::create(['tenant_id' => 1]);"),
    ("k % 2 = 1", r"            $item->save();"), ("true", r"            $this->price->apply('x');"), ("k % 3 = 0", r"            ItemCreated{k}::dispatch($item);"),
    ("true", r"            DB::transaction(fn () => $this->stock->settle());"), ("true", r"        });"),
    ("k % 2 = 0", r"        Ship{k}::dispatch($item);"), ("k % 2 = 1", r"        event(new Shipped{k}($item));"), ("true", r"        $item->tags()->delete();"),
    ("k % 4 = 1", r"        $item->notify(new Told{k}());"), ("k % 4 = 2", r"        Mail::to($item)->cc('x')->queue(new Sent{k}());"), ("true", r"        return $this->stock->report($item);"), ("true", r"    }"),
    ("true", r"    private function ensureOpen($item)"), ("true", r"    {"), ("true", r"        if ($item->closed()) { throw new Closed(); }"), ("true", r"    }"),
    ("true", r"    private function prepare($item)"), ("true", r"    {"), ("true", r"        $this->price->warm();"), ("true", r"        $this->authorize('prepare', $item);"), ("true", r"    }"), ("true", r"}"),
)
REQUEST = (("true", r"<?php"), ("true", r"class P{k}Request extends FormRequest"), ("true", r"{"), ("k % 2 = 0", r"    public function authorize() { return $this->user()?->owns({k}); }"), ("true", r"}"))
POLICY = (("true", r"<?php"), ("true", r"namespace App\Policies;"), ("true", r"use App\Services\StockService;"), ("true", r"class P{k}Policy { public function __construct(private StockService $stock) {} public function update($u) { return $this->stock->owns('it'); } }"))
STOCK = r"""<?php
namespace App\Services;
use App\Services\{PriceService, LedgerService};
class StockService
{
    public function __construct(private PriceService $price, private LedgerService $ledger) {}
    public function fast($when, $how) { Activity::add('fast', 'x'); return Stock::where('tenant_id', 1)->first(); }
    public function slow() { DB::transaction(function () { Stock::create([]); $this->ledger->book(); }); }
    public function settle() { foreach (Stock::all() as $s) { $s->save(); } $this->ledger->close('day'); $this->assertOpen(); }
    public function report($item) { if (!$item) { abort(404); } return resolve('organization'); }
    public function owns($x) { $t = app()->make('x'); return $this->ledger->owns($x); }
    private function assertOpen() { $a = 1; if ($a) throw new Closed(); }
}"""
LEDGER = r"""<?php
namespace App\Services;
class LedgerService
{
    public function book() { Entry::insert(['organization_id' => 2]); activity()->log('book'); }
    public function close($d) { Entry::latest()->paginate(10); Entry::update(['x' => "tenant"]); }
    public function owns($x) { return Entry::find($x); }
}"""
PRICE = r"""<?php
namespace App\Services;
class PriceService
{
    public function quote($a) { return 1; }
    public function apply($a) { $x = 1; if ($x > 2) { log('a'); abort(403); } return 2; }
}"""
SINKS = ("Activity::add", "activity()->log")


def _text(lines) -> F.Column:
    k = F.col("k").cast("string")
    return F.concat_ws("\n", *(F.when(F.expr(c), F.replace(F.lit(x), F.lit("{k}"), k)) for c, x in lines))


def spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's rows dealt over all tasks by their key: a small file is one task, but the texts made of its rows, and what reads them, are not small."""
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return t.repartition(n, {"part": "p_partkey", "supplier": "s_suppkey"}[name])


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, content): of each part a controller, a form request and, for all but each third, a policy; of each brand the services."""
    parts = spread(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_brand").alias("project"))
    name = lambda folder, tail: F.concat(F.lit(folder + "P"), F.col("k").cast("string"), F.lit(tail + ".php"))
    each = [(name("app/Http/Controllers/", "Controller"), CONTROLLER, "true"), (name("app/Http/Requests/", "Request"), REQUEST, "true"), (name("app/Policies/", "Policy"), POLICY, "k % 3 <> 0")]
    files = F.array(*(F.when(F.expr(c), F.struct(path.alias("path"), _text(lines).alias("content"))) for path, lines, c in each))
    own = parts.select("project", F.explode(files).alias("f")).where("f is not null").select("project", "f.path", "f.content")
    shared = F.array(*(F.struct(F.lit(f"app/Services/{n}.php").alias("path"), F.lit(t).alias("content")) for n, t in (("StockService", STOCK), ("LedgerService", LEDGER), ("PriceService", PRICE))))
    return own.unionByName(parts.select("project").distinct().select("project", F.explode(shared).alias("f")).select("project", "f.path", "f.content"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of one handler: the ``store`` of each part's controller: graph_id, project, path, class, method, caller (the handler's id)."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("graph_id"), F.col("p_brand").alias("project"))
    klass = F.concat(F.lit("P"), F.col("graph_id").cast("string"), F.lit("Controller"))
    return parts.select("graph_id", "project", F.concat(F.lit("app/Http/Controllers/"), klass, F.lit(".php")).alias("path"), klass.alias("class"), F.lit("store").alias("method"), F.lit("handler").alias("caller"))


#: lines of a supplier's route file
ROUTES = (
    ("true", r"<?php"), ("k % 2 = 0", r"use App\Web\S{k}Controller;"), ("true", r"Route::get('/s{k}', [S{k}Controller::class, 'index']);"),
    ("true", r"Route::group(['prefix' => 'x', 'middleware' => ['role:admin', Perm::class]], function () {"), ("true", r"    Route::post('y/{id}', 'S{k}Controller@save')->middleware('can:' . Permission::EDIT);"),
    ("true", r"    Route::prefix('deep')->middleware('throttle:60')->group(fn () => [Route::delete('z', \Other\ZController::class)]);"), ("true", r"});"),
    ("true", r"Route::apiResource('things', ThingController::class)->only(['index', 'destroy'])->middleware('signed');"), ("k % 7 = 0", r"require __DIR__ . '/../api.php';"), ("k % 3 = 0", r"// require 'routes/none.php';"),
)
KERNEL = r"""<?php
class Kernel { protected $middlewareGroups = ['api' => [\App\Http\Middleware\Authenticate::class, 'throttle:api']]; protected $routeMiddleware = ['role' => \App\Http\Middleware\HasRole::class, 'nothing' => 'x']; }"""
PROVIDER = r"""<?php
class RouteServiceProvider extends ServiceProvider { protected $namespace = 'App\Api';
    public function map() { Route::prefix('old')->middleware('web')->namespace($this->namespace)->group(base_path('routes/api.php'));
        Route::group(['prefix' => 'v2', 'middleware' => ['api', 'web']], function () { require base_path('routes/api.php'); }); } }"""
BOOTSTRAP = r"""<?php
return Application::configure()->withRouting(api: __DIR__ . '/../routes/api.php', commands: __DIR__.'/../routes/console.php', apiPrefix: 'api/v1')->withMiddleware(function ($m) { $m->alias(['role' => \App\Http\Middleware\EnsureRole::class]); });"""
API = r"""<?php
Route::middleware('auth:api')->prefix('n')->group(function () { require __DIR__ . '/g0.php'; Route::prefix('in')->group(function () { require_once __DIR__ . "/g1.php"; }); });
require 'routes/g2.php';"""
PERMISSION = r"""<?php
class Permission { public const EDIT = 'edit'; const OTHER = 1; }"""


def route_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, content): projects by nation, whose api file includes three others, which include a file a supplier; some of those include the api file again."""
    s = spread(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_nationkey").cast("long").alias("n"))
    s = s.withColumns({"project": F.concat(F.lit("nation-"), F.col("n").cast("string")), "g": F.col("k") % 3})
    own = s.select("project", F.concat(F.lit("routes/s/s"), F.col("k").cast("string"), F.lit(".php")).alias("path"), _text(ROUTES).alias("content"))
    line = F.concat(F.lit("require __DIR__ . '/s/s"), F.col("k").cast("string"), F.lit(".php';"))
    many = s.groupBy("project", "g").agg(F.concat(F.lit("<?php\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("content")).select("project", F.concat(F.lit("routes/g"), F.col("g").cast("string"), F.lit(".php")).alias("path"), "content")
    n = s.select("project", "n").distinct()
    fixed = [("app/Http/Kernel.php", KERNEL, "n % 2 = 0"), ("app/Providers/RouteServiceProvider.php", PROVIDER, "n % 2 = 0"), ("bootstrap/app.php", BOOTSTRAP, "n % 2 = 1"), ("routes/api.php", API, "true"), ("app/Permission.php", PERMISSION, "n % 3 > 0")]
    shared = n.select("project", F.explode(F.array(*(F.when(F.expr(c), F.struct(F.lit(p).alias("path"), F.lit(t).alias("content"))) for p, t, c in fixed))).alias("f")).where("f is not null").select("project", "f.path", "f.content")
    return own.unionByName(many).unionByName(shared)


LISTENER = (("true", r"<?php"), ("k % 3 = 0", r"use Illuminate\Contracts\Events\ShouldHandleEventsAfterCommit;"), ("true", r"class L{k}"), ("k % 3 = 0", r"    implements ShouldHandleEventsAfterCommit"), ("true", r"{"), ("k % 2 = 0", r"    public $afterCommit = true;"), ("true", r"    public function handle($e) { $afterCommit = 1; }"), ("true", r"}"))
RULES = (
    ("true", r"<?php"), ("true", r"class R{k}Request extends FormRequest {"), ("true", r"    public function rules() { $x = ['no' => 'required'];"), ("true", r"        return ["),
    ("true", r"            'name' => 'required|string|min:2|max:{k}',"), ("k % 2 = 0", r"            'tags.*.id' => ['integer', 'nullable', 'between:1,{k}', Rule::exists('t', 'x')],"), ("true", r"            'age' => ' numeric | min:1.5|in: a, b',"),
    ("k % 3 = 0", r"            'mail' => ['sometimes', 'email', 'regex:/^a|b$/'],"), ("k % 4 = 0", r"            'name' => ['email'],"), ("true", r"""            'on' => "boolean", 'list' => ['array', 'max:5'], 'odd' => $x, 'none' => [],"""), ("true", r"        ]; }"), ("true", r"}"),
)
RESOURCE_FILE = (
    ("true", r"<?php"), ("true", r"class R{k}Resource extends JsonResource {"), ("true", r"    public function toArray($r) {"), ("k % 2 = 0", r"        return ['id' => $this->id, 'api_token' => $this->when('secret', fn () => ['inner' => 1]), 'owner' => new OwnerResource($this->owner), 'items' => ItemResource::collection($this->items)];"),
    ("k % 2 = 1", r"        return array_merge(['id' => 1, 'PASSWORD' => 2], parent::toArray($r), ['last' => OwnerResource::make($this->whenLoaded('owner'))]);"), ("true", r"    }"), ("true", r"}"),
)

JOB = (("true", r"<?php"), ("k % 2 = 0", r"interface ShouldBe {} class Other implements Thing {}"), ("true", r"class J{k}"), ("k % 5 > 0", r"    implements Another, ShouldQueue"), ("true", r"{"), ("k % 3 = 0", r"    public $queue = 'q{k}';"), ("true", r"    public function handle() { $queue = 'no'; }"), ("true", r"}"))
KERNEL_OF = (
    ("true", r"<?php"), ("true", r"class Kernel{k} { protected function schedule(Schedule $schedule) {"), ("true", r"    $schedule->command('mail:send {k}')->withoutOverlapping()->everyThirtyMinutes();"), ("k % 2 = 0", r"    $schedule->job(new J{k}(1))->cron('5 * * * 1');"),
    ("k % 3 = 0", r"    $schedule->job(J{k}::class)->quarterly()->daily();"), ("true", r"    $schedule->call(fn () => 1)->hourly(); $other->command('x')->daily(); $schedule->exec('ls');"), ("true", r"}"),
    ("k % 4 = 0", r"    function boot() { dispatch(new J{k}x(1)); return new R{k}Resource(2); }"), ("k % 4 = 1", r"    function boot() { Bus::chain([new J{k}]); R{k}Resource::collection([]); Gate::check('see', $x); Gate::denies( 'edit'); }"), ("k % 4 = 2", r"    function boot() { AJ{k}::dispatch(); }"), ("true", r"}"),
)


def shape_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, content): of each supplier a listener, a form request and a resource; of each nation a provider that maps events to listeners."""
    s = spread(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("project"))
    name = lambda folder, tail: F.concat(F.lit(f"app/{folder}"), F.col("k").cast("string"), F.lit(f"{tail}.php"))
    own = F.array(*(F.struct(p.alias("path"), _text(lines).alias("content")) for p, lines in ((name("Listeners/L", ""), LISTENER), (name("Http/Requests/R", "Request"), RULES), (name("Http/Resources/R", "Resource"), RESOURCE_FILE), (name("Jobs/J", ""), JOB), (name("Console/K", "Kernel"), KERNEL_OF), (name("vendor/V", ""), JOB))))
    k = F.col("k").cast("string")
    line = F.when(F.col("k") % 2 == 0, F.concat(F.lit("E"), k, F.lit("::class => [L"), k, F.lit("::class, 'App\\Listeners\\Gone'],"))).otherwise(F.concat(F.lit("'App\\Events\\E"), k, F.lit("' => ['App\\Listeners\\L"), k, F.lit("'],")))
    use = F.when(F.col("k") % 4 == 0, F.concat(F.lit("use App\\Listeners\\L"), k, F.lit(";")))
    p = s.groupBy("project").agg(F.concat_ws("\n", F.lit("<?php"), F.array_join(F.array_sort(F.collect_list(use)), "\n"), F.lit("class EventServiceProvider { protected $listen = ["), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("]; }")).alias("content"))
    return s.select("project", F.explode(own).alias("f")).select("project", "f.path", "f.content").unionByName(p.select("project", F.lit("app/Providers/EventServiceProvider.php").alias("path"), "content"))


#: lines of a supplier's file in a Go project
GO_ROUTES = (
    ("true", "package routes"), ("true", "func RegisterS{k}(rg gin.IRouter, h *handler.S{k}Handler) {"), ("true", '\tg := rg.Group("/s{k}")'), ("true", "\t{"), ("true", '\t\tg.GET("/:id", h.Get)'), ("true", '\t\tg.POST("", Limit({k}), gin.Recovery, h.Create) // g.PUT("/no", h.No)'), ("true", "\t}"),
    ("k % 3 = 0", '\tg.DELETE("/:id", func(c *gin.Context) { c.Status(204) })'), ("k % 5 = 0", "\tRegisterS{k}(g, h)"), ("true", "\tif h != nil {"), ("true", '\t\tg.PUT("/branch", h.Get)'), ("true", "\t}"), ("true", "}"),
    ("true", "type S{k}Request struct {"), ("true", '\tName, Other string `json:"n" binding:"required"`'), ("true", '\tNote string `json:"note"`'), ("k % 2 = 0", '\tAge int `binding:"gte={k}"`'), ("true", "}"),
    ("true", "type S{k}Handler struct { svc *service.S{k}Service }"), ("true", "func (h *S{k}Handler) Get(c *gin.Context) {}"), ("true", "func (h *S{k}Handler) Create(c *gin.Context) {"), ("true", "\tvar req dto.S{k}Request"),
    ("k % 2 = 0", "\tif err := c.ShouldBindJSON(&req); err != nil {"), ("k % 2 = 0", "\t\treturn"), ("k % 2 = 0", "\t}"), ("k % 2 = 1", "\tc.ShouldBind(&req)"), ("k % 7 = 0", "\th.db.WithContext(c).Transaction(func(tx *gorm.DB) error { return nil })"), ("true", "\th.svc.Create(req)"), ("true", "}"),
    ("k % 4 < 2", "func (s *S{k}Service) Create(x any) { s.db.Transaction(func(tx *gorm.DB) error { return nil }) }"), ("k % 4 >= 2", "func (s *S{k}Service) Create(x any) { s.db.Transaction(func(tx *sql.Tx) error { return nil }) }"),
)
GO_MAIN = """package main
func main() {
	r := %s
	r.Use(middleware.AuthMiddleware(cfg))
	api := r.Group("/api")
	routes.Register(api, nil)
	r.GET("/health", health)
}"""
GO_FACTORY = """package server
func NewRouter(c Config) *gin.Engine {
	e := gin.New()
	e.Use(middleware.Logger())
	return e
}"""
GO_SHARED = """package middleware
const (
	RoleAdmin = "admin"
	Count     = iota
)
func versioned(c Config, g *gin.RouterGroup) *gin.RouterGroup {
	w := g.Group("/v1", middleware.RequireRole(model.RoleAdmin, "x"))
	return w
}
func AuthMiddleware(c Config) gin.HandlerFunc {
	skip := map[key]bool{
		{http.MethodGet, "/health"}: true,
		{"post", "/api/none"}:       true,
	}
	return nil
}"""


def go_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, content): Go projects of twenty suppliers each; main, a factory, what is shared, a registrar that calls each supplier's own, and that in a file of its own."""
    s = spread(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    s = s.withColumn("n", F.expr("k div 20")).withColumn("project", F.concat(F.lit("go-"), F.col("n").cast("string")))
    own = s.select("project", F.concat(F.lit("routes/s"), F.col("k").cast("string"), F.lit(".go")).alias("path"), _text(GO_ROUTES).alias("content"))
    line = F.concat(F.lit("\tRegisterS"), F.col("k").cast("string"), F.lit("(v, h)"))
    many = s.groupBy("project").agg(F.concat(F.lit("package routes\nfunc Register(api *gin.RouterGroup, h *H) {\n\tv := versioned(h, api)\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n}")).alias("content")).select("project", F.lit("routes/register.go").alias("path"), "content")
    fixed = [("cmd/main.go", GO_MAIN % "gin.Default()", "n % 2 = 0"), ("cmd/main.go", GO_MAIN % "server.NewRouter(cfg)", "n % 2 = 1"), ("server.go", GO_FACTORY, "true"), ("shared.go", GO_SHARED, "true"), ("cmd/seed.go", "package main\nfunc main() { println() }", "n % 2 = 0")]
    shared = s.select("project", "n").distinct().select("project", F.explode(F.array(*(F.when(F.expr(c), F.struct(F.lit(p).alias("path"), F.lit(t).alias("content"))) for p, t, c in fixed))).alias("f")).where("f is not null").select("project", "f.path", "f.content")
    return own.unionByName(many).unionByName(shared)


NEST = (
    ("true", "import { Controller } from '@nestjs/common';"), ("true", "@Controller('s{k}')"), ("k % 2 = 0", "@UseGuards(JwtAuthGuard)"), ("true", "export class S{k}Controller {"), ("true", "  // @Get('never') never() {}"), ("true", "  @Get() list() { return []; }"),
    ("k % 4 = 0", "  @Public()"), ("true", "  @Post(':id')"), ("k % 3 = 0", "  @UseGuards(RolesGuard)"), ("true", "  async save(@Param('id') id: string) { return { a: 1 }; }"), ("true", "}"),
)
SPRING = (
    ("true", "@RestController"), ("true", '@RequestMapping("/s{k}")'), ("k % 2 = 0", '@PreAuthorize("isAuthenticated()")'), ("true", "public class S{k}Controller {"), ("true", '  @GetMapping("/{id}")'), ("true", "  public Item one(@PathVariable Long id) { return null; }"),
    ("true", "  @DeleteMapping"), ("k % 3 = 0", '  @PreAuthorize("hasRole(\'ADMIN\')")'), ("true", "  public void drop() {}"), ("true", "}"),
)


def web_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, content): of each supplier a route file in PHP, a NestJS and a Spring controller and, for each fifth, a file that holds no routes."""
    s = spread(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("project"))
    name = lambda folder, tail: F.concat(F.lit(folder), F.col("k").cast("string"), F.lit(tail))
    php = (("true", "<?php"), ("true", "Route::get('/s{k}', [S{k}Controller::class, 'index'])->middleware('auth:api');"), ("k % 2 = 0", "Route::prefix('x')->group(function () { Route::put('y/{id}', 'S{k}Controller@save'); });"))
    files = [(name("routes/s", ".php"), php, "true"), (name("src/s", ".controller.ts"), NEST, "true"), (name("java/S", "Controller.java"), SPRING, "true"), (name("docs/s", ".md"), (("true", "Route::get('/no', 'X@y');"),), "k % 5 = 0")]
    own = F.array(*(F.when(F.expr(c), F.struct(path.alias("path"), _text(lines).alias("content"))) for path, lines, c in files))
    return s.select("project", F.explode(own).alias("f")).where("f is not null").select("project", "f.path", "f.content")


DTO = (
    ("true", "import { IsString, Min } from 'class-validator';"), ("true", "// export class No { @IsString() no: string; }"), ("true", "export class R{k}Dto extends Base {"), ("true", "  @IsString()"), ("true", "  @MinLength(2)"), ("true", "  @MaxLength({k}, { message: 'a) b' })"), ("true", "  readonly name: string;"),
    ("k % 2 = 0", "  @IsOptional() @IsInt()"), ("k % 2 = 0", "  @Max({k})"), ("k % 2 = 0", "  count?: number | null = 1;"), ("true", "  @IsIn(['a', \"b\"])"), ("true", "  @Matches(/^[a-z(\"]+$/i)"), ("true", "  age: string[]"),
    ("k % 3 = 0", "  @Length(1, 5)"), ("k % 3 = 0", "  @IsEnum(Kind)"), ("k % 3 = 0", "  kind: Kind"), ("true", "  plain: string;"), ("true", "  @Transform(() => { return 1; })"), ("true", "  method(a: string): void { const b: number = 1; }"), ("k % 5 = 0", "  @ValidateNested({ each: true })"), ("k % 5 = 0", "  items: Array<Item>;"), ("true", "}"), ("true", "class Hidden { @IsString() a: string; }"),
)


def dto_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, content): of each supplier the class that its form request has as a counterpart, and a declaration file."""
    s = spread(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("project"))
    name = lambda tail: F.concat(F.lit("src/r"), F.col("k").cast("string"), F.lit(tail))
    return s.select("project", F.explode(F.array(F.struct(name(".dto.ts").alias("path"), _text(DTO).alias("content")), F.struct(name(".d.ts").alias("path"), _text(DTO).alias("content")))).alias("f")).select("project", "f.path", "f.content")
