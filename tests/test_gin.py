"""Routers of Go projects that go from function to function: what is given back, contexts, graphs."""
import random

import pytest

from graphmill.operators import gin
from graphmill.sources.gosyntax import GoReader, go_syntax

FILES = "project string, path string, content string"


def read(spark, **files):
    return go_syntax(spark.createDataFrame([("p", k + ".go", v) for k, v in files.items()], FILES)).cache()


def found(s, entry="main"):
    return [(r.method, r.path, r.handler, [g.name for g in r.gates]) for r in gin.routes(s, entry=entry).orderBy("places").collect()]


@pytest.mark.parametrize("text", ["", "func", "func (", "func f(", "func f() {", "type A struct {", "const (", "map[", "x :=", "func main() { r := gin.New(); r.GET(", "`open", "\"open", "'", "}}}", "func (a) b", "var x", "a.b.c(", "func f(" + "(" * 2000, "type", "const"])
def test_texts_that_break_off_are_read_as_far_as_they_go(text):
    for r in GoReader(text).read():
        assert 0 <= r["at"] <= len(text)


def test_groups_across_functions_and_files(spark):
    s = read(spark, main='''package main
func main() {
	r := gin.Default() // not r.GET("/c", h)
	r.Use(mw.Logger(), gin.Recovery)
	api := r.Group("/api", mw.Auth(cfg))
	r.Use(mw.Late())
	{
		api.GET("/a/:id", h.Get)
		{ api.POST(`/b`, inline(1), plain, h.Post) }
	}
	if x { api.GET("/no", h.No) }
	v := wrap(api,
		h)
	routes.Register(v, h)
	routes.Register(api.Group("/lost"), h)
	own := NewRouter()
	own.HEAD("/own", f)
	own = nothing(own)
	own.OPTIONS("/still", f)
	unknown.GET("/x", f)
}''', seed="package main\nfunc main() { println() }\nfunc nothing(r *gin.Engine) { r.PATCH(\"/in\", f) }", routes='''package routes
func wrap(a, b *gin.RouterGroup) *gin.RouterGroup {
	g := a.Group("/w")
	return g
}
func Register(r gin.IRouter, o *handler.OrderHandler) {
	r.PUT("/p", o.Put)
	Register(r, o)
	again(r)
}
func again(r gin.IRouter) { Register(r, nil); r.DELETE("/d", func(c *gin.Context) { c.JSON(1) }) }
func NewRouter() *gin.Engine {
	e := gin.New()
	e.Use(mw.Own())
	return e
}''')
    assert found(s) == [
        ("GET", "/api/a/:id", "h.Get", ["Logger", "Auth"]), ("POST", "/api/b", "h.Post", ["Logger", "Auth", "inline"]), ("PUT", "/api/w/p", "o.Put", ["Logger", "Auth"]),
        ("DELETE", "/api/w/d", "func(c *gin.Context) { c.JSON(1) }", ["Logger", "Auth"]), ("HEAD", "/own", "f", ["Own"]), ("PATCH", "/in", "f", ["Own"]), ("OPTIONS", "/still", "f", ["Own"])]
    assert found(s, "none") == []
    assert [r.holder for r in gin.routes(s).where("method = 'PUT'").collect()] == ["OrderHandler"]


def test_functions_that_give_back_each_other_have_what_is_left(spark):
    s = read(spark, main='''
func main() { r := a(1); r.GET("/no", f); q := gin.New(); q = keep(q); q.GET("/yes", f) }
func a(x int) *gin.Engine { r := b(x); return r }
func b(x int) *gin.Engine { r := a(x); return r }
func keep(r *gin.Engine) *gin.Engine { r = keep(r); g := r.Group("/k"); return g }''')
    assert found(s) == [("GET", "/k/yes", "f", [])]


def test_bindings_transactions_exemptions_and_constants(spark):
    s = read(spark, main='''
func main() {
	r := gin.New()
	r.Use(middleware.AuthMiddleware(cfg), Limit(model.MAX, 5))
	Orders(r, nil)
	r.POST("/login", Login)
}
func Orders(r *gin.Engine, h *OrderHandler) {
	r.POST("/orders", RequireRole(model.RoleAdmin), h.Create)
	r.PUT("/orders", h.Update)
	r.GET("/orders", h.List)
}''', model='''
const RoleAdmin = "admin"
const (
	MAX = 7
	NAME, OTHER = "n", "o"
)
type OrderHandler struct {
	orders *service.OrderService
	a, b   int
}
type CreateOrder struct {
	Name string `json:"name" binding:"required,min=2"`
	Note string `json:"note"`
	Age  int    `binding:"gte=1"`
}
type Empty struct {}
func (h *OrderHandler) Create(c *gin.Context) {
	var req dto.CreateOrder
	if err := c.ShouldBindJSON(&req); err != nil {
		return
	}
	h.orders.Log(req)
	h.orders.Create(req)
}
func (h OrderHandler) Update(c *gin.Context) {
	req := CreateOrder{}
	c.ShouldBind(&req)
	h.db.WithContext(c).
		Transaction(func(tx *gorm.DB) error { return nil })
}
func (h *OrderHandler) List(c *gin.Context) {
	var q Empty
	c.ShouldBindQuery(&q)
	h.db.Transaction(func(tx *sql.Tx) error { return nil })
}
func (s *OrderService) Log(x any) {}
func (s *OrderService) Create(x any) { s.db.Transaction(func(tx *gorm.DB) error { return nil }) }
func AuthMiddleware(c Config) gin.HandlerFunc {
	skip := map[key]bool{
		{http.MethodPost, "/login"}: true,
		{"get", "/x"}:               true,
	}
	return nil
}''')
    r = gin.routes(s)
    n = gin.nodes(r, s)
    chain = {}
    for x in n.orderBy("places", "nth").collect():
        chain.setdefault(f"{x.method} {x.path}", []).append((x.id, x.symbol, x.args, x.detail))
    auth, limit = ("mw_0", "middleware.AuthMiddleware(cfg)", ["cfg"], None), ("mw_1", "Limit(model.MAX, 5)", ["model.MAX", "5"], None)
    rules = ["Name:required,min=2", "Age:gte=1"]
    assert chain == {
        "POST /orders": [auth, limit, ("mw_2", "RequireRole(model.RoleAdmin)", ["admin"], None), ("validation", "CreateOrder", rules, "bound via ctx.ShouldBindJSON"), ("handler", "h.Create", [], None), ("txn", "OrderService.Create", [], None)],
        "PUT /orders": [auth, limit, ("validation", "CreateOrder", rules, "bound via ctx.ShouldBindUri"), ("handler", "h.Update", [], None), ("txn", "h.Update", [], None)],
        "GET /orders": [auth, limit, ("handler", "h.List", [], None)], "POST /login": [limit, ("handler", "Login", [], None)]}
    assert {(x["from"], x["to"]) for x in gin.edges(n).collect()} >= {("mw_2", "validation"), ("handler", "txn")}
    assert {(x.name, x.value) for x in gin.constants(s).collect()} == {("RoleAdmin", "admin"), ("NAME", "n")}


def walk(functions, name, given, stack, out):
    """The plain walk: statements in order, calls at once."""
    if name in stack:
        return None
    params, body = functions[name]
    state = dict(given)
    for s in body:
        if s[0] == "new":
            state[s[1]] = ("", ())
        elif s[0] == "group" and s[2] in state:
            state[s[1]] = (state[s[2]][0] + s[3], state[s[2]][1] + (s[4],))
        elif s[0] == "use" and s[1] in state:
            state[s[1]] = (state[s[1]][0], state[s[1]][1] + (s[2],))
        elif s[0] == "verb" and s[1] in state:
            out.append((state[s[1]][0] + s[2], list(state[s[1]][1])))
        elif s[0] in ("call", "take") and s[2] in functions:
            inner = {p: state[a] for p, a in zip(functions[s[2]][0], s[3]) if a in state}
            if s[0] == "take" or inner:
                back = walk(functions, s[2], inner, [*stack, name], out)
                if s[0] == "take" and back:
                    state[s[1]] = back
    return next((state[s[1]] for s in body if s[0] == "back" and s[1] in state), None)


def test_random_programs_give_what_a_plain_walk_gives(spark):
    rng, rows, want = random.Random(5), [], {}
    for p in range(60):
        names = ["main", *(f"F{k}" for k in range(6))]
        functions = {}
        for k, name in enumerate(names):
            params = [] if name == "main" else rng.sample(["a", "b", "c"], rng.randint(0, 3))
            var = lambda: rng.choice(["a", "b", "c", "d"])
            body = [("new", "a")] if name == "main" or rng.random() < 0.3 else []
            for n in range(rng.randint(5, 11)):
                later = rng.choice([*names[k + 1:], "none"])  # no cycles: a function that gives back itself is a case of its own
                body.append(rng.choice([("group", var(), var(), f"/g{n}", f"m{name}{n}"), ("use", var(), f"u{name}{n}"), ("verb", var(), f"/{name}{n}"), ("verb", var(), f"/{name}{n}"), ("call", None, later, [var(), var()]), ("take", var(), later, [var(), var()])]))
            if rng.random() < 0.7:
                body.append(("back", var()))
            functions[name] = (params, body)
        text = []
        for name, (params, body) in functions.items():
            line = {"new": "{1} := gin.New()", "group": '{1} = {2}.Group("{3}", {4}())', "use": "{1}.Use({2}())", "verb": '{1}.GET("{2}", f)', "back": "return {1}"}
            said = [f"{s[1]} = " * (s[0] == "take") + f"{s[2]}({', '.join(s[3])})" if s[0] in ("call", "take") else line[s[0]].format(*s) for s in body]
            text.append(f"func {name}({', '.join(x + ' *gin.Engine' for x in params)}) {{\n\t" + "\n\t".join(said) + "\n}")
        rows += [(f"p{p}", f"f{k}.go", t) for k, t in enumerate(text)]
        want[f"p{p}"] = []
        walk(functions, "main", {}, [], want[f"p{p}"])
    got = {k: [] for k in want}
    for r in gin.routes(go_syntax(spark.createDataFrame(rows, FILES)).cache()).collect():
        got[r.project].append((r.path, [g.name for g in r.gates]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(map(len, want.values())) > 200


def test_empty_tables_and_null_files(spark):
    none = go_syntax(spark.createDataFrame([("p", "a.go", None), ("p", "b_test.go", "func main() { r := gin.New(); r.GET(\"/\", f) }"), ("q", None, "func main() {}")], FILES))
    r = gin.routes(none)
    assert r.count() == 0 and gin.nodes(r, none).count() == 0 and gin.edges(gin.nodes(r, none)).count() == 0
    assert gin.bindings(none).union(gin.bindings(none)).count() == 0 and gin.transactions(none).count() == 0
