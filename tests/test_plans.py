from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.plans.compiler import Capability, NodeEffects, compatible, explain, hydrate, layered, optimize, validate
from sparkloom.plans.frontends import (
    IntentBuilder, PlanBuilder, RecipeBuilder, capabilities, compile_intent, compile_recipe, fan_out, parse_params, ref, run_by_cli, splice,
)
from sparkloom.plans.ir import (
    Cost, Effects, Limits, Node, PlanError, ResolutionError, Tool, ValueRef, canonical, collect_refs, dump, escape_segment, fill_template,
    parse_plan, resolve_input, unescape_segment,
)
from sparkloom.plans.mining import suggest
from sparkloom.plans.schema import check_document
from sparkloom.sources.base import as_column_function

PURE = Effects(pure=True, cacheable=True, batchable=True)


def plan(*nodes, tools=None, outputs=None):
    doc = {"version": "0", "tools": tools or {"t": {"adapter": "local", "effects": {"pure": True, "batchable": True}}}, "nodes": list(nodes), "outputs": outputs or {}}
    return parse_plan(doc)


def refused(kind, f, *args):
    with pytest.raises(PlanError) as e:
        f(*args)
    assert e.value.kind == kind


# --- references and values --------------------------------------------------------------------------------------


@given(st.text(min_size=1).filter(lambda s: "." not in s), st.lists(st.text(min_size=1)))
def test_references_round_trip(node, path):
    r = ValueRef(node, tuple(path))
    assert ValueRef.parse(str(r)) == r


@given(st.text())
def test_any_text_is_a_reference_or_refused(text):
    try:
        assert str(ValueRef.parse(text))
    except PlanError as e:
        assert e.kind == "invalid_ref"


@given(st.text())
def test_segments_round_trip(s):
    assert unescape_segment(escape_segment(s)) == s and "." not in escape_segment(s)


@pytest.mark.parametrize("bad", ["", "a", "a.out", "a.output.", "a.output..b", ".output"])
def test_bad_references(bad):
    refused("invalid_ref", ValueRef.parse, bad)


def test_inputs_resolve_and_literals_stay():
    outputs = {"a": {"x": [1, {"y": None}]}}
    template = {"v": {"$ref": "a.output.x.1.y"}, "l": {"$literal": {"$ref": "no"}}, "k": [{"$ref": "a.output.x.0"}]}
    assert resolve_input(template, outputs) == {"v": None, "l": {"$ref": "no"}, "k": [1]}
    with pytest.raises(ResolutionError) as e:
        resolve_input({"$ref": "a.output.z"}, outputs)
    assert e.value.code == "missing_path"
    with pytest.raises(ResolutionError) as e:
        resolve_input({"$ref": "b.output"}, outputs)
    assert e.value.code == "missing_node_output"
    assert [str(r) for r in collect_refs(template)] == ["a.output.x.1.y", "a.output.x.0"]
    refused("invalid_marker", collect_refs, {"$ref": "a.output", "more": 1})


def test_items_fill_templates_but_not_data():
    outputs = {"a": {"$item": "x"}}
    assert resolve_input({"i": {"$item": "k.0"}, "d": {"$ref": "a.output"}, "all": {"$item": ""}}, outputs, {"k": [7]}) == {"i": 7, "d": {"$item": "x"}, "all": {"k": [7]}}
    with pytest.raises(ResolutionError) as e:
        resolve_input({"$item": "z"}, {}, {})
    assert e.value.code == "invalid_item"


def test_templates_are_all_or_nothing():
    assert fill_template("file:{a.b}/{n}", {"a": {"b": "x"}, "n": 1.5}) == ("file:x/1.5", True)
    assert fill_template("{a}{b}", {"a": "x"}) == ("{a}{b}", False)
    assert fill_template("{a}", {"a": [1]}) == ("{a}", False)
    assert fill_template("a{b", {"b": 1}) == ("a{b", True)
    assert fill_template("{a}", {"a": "{a}"}) == ("{a}", True)


def test_canonical_text():
    assert canonical({"b": [1, 2.0], "a": "é\n"}) == '{"a":"é\\n","b":[1,2.0]}'


# --- strict parsing ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("doc", "kind"),
    [
        ({}, "missing_field"), ({"version": "1"}, "unsupported_version"), ({"version": "0", "x": 1}, "unknown_field"), ([], "invalid_document"),
        ({"version": "0", "nodes": [{"id": "a"}]}, "missing_field"), ({"version": "0", "nodes": [{"id": "a", "tool": "t", "y": 1}]}, "unknown_field"),
        ({"version": "0", "tools": {"t": {"adapter": "l", "effects": {"pure": "yes"}}}}, "invalid_field"),
        ({"version": "0", "tools": {"t": {"adapter": "l", "effects": {"timeout_ms": 0}}}}, "invalid_field"),
        ({"version": "0", "outputs": {"o": "a"}}, "invalid_ref"),
    ],
)
def test_strict_parsing(doc, kind):
    refused(kind, parse_plan, doc)


@pytest.mark.parametrize(
    ("nodes", "more", "kind"),
    [
        ([{"id": "a.b", "tool": "t"}], {}, "invalid_node_id"), ([{"id": "a", "tool": "t"}] * 2, {}, "duplicate_id"), ([{"id": "a", "tool": "u"}], {}, "unknown_tool"),
        ([{"id": "a", "tool": "t", "depends_on": ["a"]}], {}, "self_dependency"), ([{"id": "a", "tool": "t", "input": {"$ref": "z.output"}}], {}, "unknown_dependency"),
        ([{"id": "a", "tool": "t"}], {"outputs": {"o": "z.output"}}, "unknown_output"),
        ([{"id": "a", "tool": "t", "depends_on": ["b"]}, {"id": "b", "tool": "t", "depends_on": ["a"]}], {}, "cycle"),
        ([], {"tools": {"t": {"adapter": "l", "effects": {"pure": True, "writes": ["x"]}}}}, "contradictory_effects"),
    ],
)
def test_validation(nodes, more, kind):
    refused(kind, validate, plan(*nodes, **more))


def test_plans_round_trip():
    p = plan({"id": "a", "tool": "t", "input": {"x": 1}, "when": {"ref": "b.output", "equals": None, "not": True}}, {"id": "b", "tool": "t", "depends_on": []})
    again = parse_plan(dump(p))
    assert again == p and again.nodes[0].when.equals is None


# --- front-ends -------------------------------------------------------------------------------------------------


def test_intents_lower():
    steps = [{"id": "audit", "tool": "t"}, {"id": "user", "tool": "t", "input": {"id": "u"}}, {"id": "p", "tool": "t", "input": {"u": {"$ref": "user.output.id"}}, "after": ["audit"]}]
    p = compile_intent({"version": "0", "name": "n", "tools": {"t": {"adapter": "local"}}, "steps": steps, "outputs": {"p": "p.output"}})
    assert p.nodes[2].depends_on == ("audit", "user") and p.name == "n"
    refused("unknown_tool", compile_intent, {"version": "0", "steps": [{"id": "a", "tool": "z"}]})


def recipe(body, **more):
    return {"version": "0", "tools": {}, "recipe": body, **more}


def test_fan_out_lowers():
    p = compile_recipe(recipe({"kind": "fan_out", "tool": "read", "items": ["a", "b"], "node_prefix": "r_", "input_key": "path"}))
    assert [(n.id, n.input) for n in p.nodes] == [("r_1", {"path": "a"}), ("r_2", {"path": "b"})]
    refused("empty_recipe", compile_recipe, recipe({"kind": "fan_out", "tool": "read", "items": []}))


def test_map_reduce_over_a_reference_lowers():
    body = {"kind": "map_reduce", "tool": "fetch", "items_ref": "s.output.hits", "node_prefix": "d_", "input_key": "doc", "reduce_tool": "sum", "reduce_input_key": "docs"}
    a, b = compile_recipe(recipe(body)).nodes
    assert (a.id, a.input, str(a.for_each)) == ("d_each", {"doc": {"$item": ""}}, "s.output.hits")
    assert (b.id, b.input) == ("d_reduce", {"docs": {"$ref": "d_each.output"}})
    whole = splice(compile_recipe(recipe(body)), [Node("s", "search")], {k: Tool("local") for k in ("search", "fetch", "sum")})
    assert validate(whole).layers == [["s"], ["d_each"], ["d_reduce"]]


def test_static_map_reduce_gathers_in_order():
    nodes = compile_recipe(recipe({"kind": "map_reduce", "tool": "f", "items": [1, 2], "reduce_tool": "g", "node_prefix": "x"})).nodes
    assert nodes[-1].input == [{"$ref": "x1.output"}, {"$ref": "x2.output"}]


def test_pipelines_lower():
    steps = [{"tool": "e", "input": {"q": 1}}, {"tool": "e", "input": {"from": {"$prev": "q"}, "all": {"$prev": ""}, "lit": {"$literal": {"$prev": "q"}}}}]
    n = compile_recipe(recipe({"kind": "pipeline", "steps": steps, "node_prefix": "s_"})).nodes[1]
    assert n.input == {"from": {"$ref": "s_1.output.q"}, "all": {"$ref": "s_1.output"}, "lit": {"$literal": {"$prev": "q"}}}
    refused("invalid_prev", compile_recipe, recipe({"kind": "pipeline", "steps": [{"tool": "e", "input": {"$prev": ""}}]}))


def test_parameters():
    body = {"kind": "fan_out", "tool": "s", "items": [{"$param": "q"}], "node_prefix": "q_", "input_key": "q"}
    doc = recipe(body, params={"q": None, "p": 1})
    assert compile_recipe(doc, {"q": "hello"}).nodes[0].input == {"q": "hello"}
    refused("missing_param", compile_recipe, doc)
    refused("unknown_param", compile_recipe, doc, {"q": 1, "z": 2})
    refused("unknown_param", compile_recipe, recipe(body))
    assert parse_params(["a=1", "b=x", 'c={"k":[]}', "d="]) == {"a": 1, "b": "x", "c": {"k": []}, "d": ""}
    refused("invalid_param", parse_params, ["a"])


# --- passes -----------------------------------------------------------------------------------------------------


def test_layers_by_resource():
    tools = {"w": {"adapter": "l", "effects": {"writes": ["f:{p}"]}}, "u": {"adapter": "l"}}
    p = plan(*[{"id": k, "tool": "w", "input": {"p": v}} for k, v in (("a", "1"), ("b", "2"), ("c", "1"))], tools=tools)
    assert validate(p).layers == [["a", "b"], ["c"]]
    assert validate(plan(*[{"id": k, "tool": "u"} for k in "ab"], tools=tools)).layers == [["a"], ["b"]]
    both = plan({"id": "a", "tool": "w", "input": {}}, {"id": "b", "tool": "w", "input": {"p": "1"}}, tools=tools)
    assert validate(both).effects["a"].effects.writes == ("f:{p}",)


def test_commutative_writes_share_a_layer():
    own = lambda c: {"w": {"adapter": "l", "effects": {"writes": ["x"], "commutative": c}}}
    nodes = [{"id": "a", "tool": "w"}, {"id": "b", "tool": "w"}]
    assert len(validate(plan(*nodes, tools=own(True))).layers) == 1 and len(validate(plan(*nodes, tools=own(False))).layers) == 2


@given(st.lists(st.tuples(st.sampled_from("tu"), st.booleans(), st.booleans(), st.sets(st.sampled_from("xyz")), st.sets(st.sampled_from("xyz"))), min_size=1, max_size=8))
def test_layers_hold_only_compatible_nodes(rows):
    from sparkloom.plans.compiler import layered

    made = {f"n{k}": Effects(pure=p and not w, commutative=c, reads=tuple(r), writes=tuple(w)) for k, (_, p, c, r, w) in enumerate(rows)}
    effects = {k: NodeEffects(rows[i][0], e.declared, e) for i, (k, e) in enumerate(made.items())}
    layers = layered({k: set() for k in effects}, effects)
    assert sorted(n for x in layers for n in x) == sorted(effects)
    for layer in layers:
        assert all(compatible(effects[a], effects[b]) for a in layer for b in layer if a < b)


def test_sharing_rewrites_references():
    p = plan(
        {"id": "a", "tool": "t", "input": {"x": 1, "y": 2}}, {"id": "b", "tool": "t", "input": {"y": 2, "x": 1}},
        {"id": "c", "tool": "t", "input": {"v": {"$ref": "b.output.k"}, "l": {"$literal": {"$ref": "b.output"}}}, "depends_on": ["b"]}, outputs={"o": "b.output", "c": "c.output"},
    )
    done = optimize(p)
    assert done.aliases == {"b": "a"} and str(done.plan.outputs["o"]) == "a.output"
    assert done.plan.nodes[1].input == {"v": {"$ref": "a.output.k"}, "l": {"$literal": {"$ref": "b.output"}}} and done.plan.nodes[1].depends_on == ("a",)


def test_cacheable_calls_share_only_in_one_context():
    tools = {"r": {"adapter": "l", "effects": {"reads": ["x"], "cacheable": True}}, "t": {"adapter": "l", "effects": {"pure": True}}}
    nodes = [{"id": "z", "tool": "t", "input": 1}, {"id": "a", "tool": "r"}, {"id": "b", "tool": "r", "depends_on": ["z"]}, {"id": "c", "tool": "r"}]
    assert optimize(plan(*nodes, tools=tools)).aliases == {"c": "a"}


def test_elimination_keeps_effects():
    tools = {"t": {"adapter": "l", "effects": {"pure": True}}, "w": {"adapter": "l", "effects": {"writes": ["x"]}}, "u": {"adapter": "l"}}
    nodes = [{"id": "a", "tool": "t", "input": 1}, {"id": "b", "tool": "t", "input": 2}, {"id": "w", "tool": "w", "input": {"$ref": "a.output"}}, {"id": "u", "tool": "u"}, {"id": "o", "tool": "t", "input": 3}]
    assert optimize(plan(*nodes, tools=tools, outputs={"o": "o.output"})).eliminated == ["b"]
    assert optimize(plan(*nodes, tools=tools)).eliminated == []


def test_batches_split_and_costs():
    tools = {"t": {"adapter": "l", "effects": {"pure": True, "batchable": True}, "limits": {"batch_size": 2}, "cost": {"fixed_ms": 10, "per_call_ms": 5, "tokens": 100}}}
    nodes = [{"id": f"n{k}", "tool": "t", "input": k} for k in range(5)]
    done = optimize(plan(*nodes, tools=tools, outputs={f"o{k}": f"n{k}.output" for k in range(5)}))
    assert [g.nodes for g in done.groups] == [("n0", "n1"), ("n2", "n3")]
    s = done.summary
    assert (s.calls_before, s.calls_after, s.serial_ms, s.compiled_ms, s.tokens_before, s.turns_after) == (5, 3, 75, 20, 500, 1)


def test_diagnostics():
    tools = {"w": {"adapter": "l", "effects": {"writes": ["db"]}}, "u": {"adapter": "l"}}
    told = explain(plan({"id": "a", "tool": "w"}, {"id": "b", "tool": "w"}, {"id": "z", "tool": "u"}, tools=tools))["diagnostics"]
    assert [(d["kind"], d["nodes"], d["resource"]) for d in told] == [("missing_effects", ["z"], None), ("resource_conflict", ["a", "b"], "db")]
    ordered = explain(plan({"id": "a", "tool": "w"}, {"id": "b", "tool": "w", "depends_on": ["a"]}, tools=tools))
    assert ordered["diagnostics"] == []


def test_hydration_takes_whole_scoped_rows():
    p = plan(tools={"a": {"adapter": "x"}, "b": {"adapter": "y", "limits": {"batch_size": 9}}})
    scoped = {("x", "a"): Capability(effects=PURE)}
    everywhere = {"a": Capability(cost=Cost(1)), "b": Capability(limits=Limits(batch_size=2), cost=Cost(2))}
    h = hydrate(p, scoped, everywhere).tools
    assert h["a"].effects == PURE and h["a"].cost is None and h["b"].limits.batch_size == 9 and h["b"].cost == Cost(2)


def test_long_chains_and_wide_plans_compile():
    chain = [{"id": f"n{k:05d}", "tool": "t", "depends_on": [f"n{k - 1:05d}"] if k else []} for k in range(20_000)]
    assert len(validate(plan(*chain)).layers) == 20_000
    b = PlanBuilder().tool("p", pure=True)
    for k in range(5000):
        b.node(f"n{k}", "p", {"k": k})
    assert len(validate(b.build()).layers) == 1


def test_builder_and_mining():
    p = PlanBuilder("x").tool("p", pure=True).node("a", "p", {"v": 1}).node("b", "p", {"v": ref("a", "k.1")}, when="a.output", equals=None).output("o", "b.output").build()
    assert p.nodes[1].input == {"v": {"$ref": "a.output.k~11"}} and validate(p).layers == [["a"], ["b"]]
    calls = [{"tool": t, "input": k} for k, t in enumerate("aaabbbc")]
    assert [(s["tool"], s["start_index"], s["items"]) for s in suggest(calls)] == [("a", 0, [0, 1, 2]), ("b", 3, [3, 4, 5])]
    assert suggest(calls, 4) == [] and len(suggest([{"tool": "a"}] * 2, 0)) == 1


@settings(max_examples=40, deadline=None)
@given(st.data())
def test_optimized_runs_equal_plain_ones(data):
    """Random plans, every node an output: passes and parallelism change no result."""
    from sparkloom.plans.runtime import Runtime
    from sparkloom.sources.base import Functions

    tools = {"pure": {"adapter": "f", "effects": {"pure": True, "batchable": True, "cacheable": True}}}
    for r in range(3):
        tools[f"read{r}"] = {"adapter": "f", "effects": {"reads": [f"res:{r}"], "cacheable": True}}
        tools[f"write{r}"] = {"adapter": "f", "effects": {"writes": [f"res:{r}"], "reads": [f"res:{r}"] if r == 2 else []}}
    nodes = []
    for k in range(data.draw(st.integers(1, 9))):
        own = {"payload": data.draw(st.integers(0, 2))}
        if k and data.draw(st.booleans()):
            own["up"] = {"$ref": f"n{data.draw(st.integers(0, k - 1))}.output"}
        if data.draw(st.booleans()):
            own["shield"] = {"$literal": {"$ref": "nothing"}}
        node = {"id": f"n{k}", "tool": data.draw(st.sampled_from(sorted(tools))), "input": own}
        if k:
            node["depends_on"] = sorted({f"n{x}" for x in data.draw(st.lists(st.integers(0, k - 1), max_size=2))})
        nodes.append(node)
    p = plan(*nodes, tools=tools, outputs={n["id"]: f"{n['id']}.output" for n in nodes})
    runtime = Runtime({"f": Functions({t: (lambda x, t=t: {"tool": t, "in": x}) for t in tools})})
    fast, slow = runtime.run(p), Runtime({"f": runtime.executors["f"]}).run_serial(p)
    assert fast.status == slow.status == "success" and fast.outputs == slow.outputs


# --- builders, documents and golden lowerings --------------------------------------------------------------------

#: (kind of document, builder, parameters, nodes of the plan).
GOLDEN = [
    ("intent", IntentBuilder("i").tool("t", pure=True).step("a", "t", {"v": 1}).step("b", "t", {"w": ref("a", "k")}).step("c", "t", [ref("b")], after=["a"]).output("o", "c.output"), {}, [
        Node("a", "t", {"v": 1}), Node("b", "t", {"w": {"$ref": "a.output.k"}}, ("a",)), Node("c", "t", [{"$ref": "b.output"}], ("a", "b")),
    ]),
    ("recipe", RecipeBuilder("r").tool("t").fan_out("t", ["x", "y"], prefix="p", key="path").output("o", "p1.output"), {}, [Node("p1", "t", {"path": "x"}), Node("p2", "t", {"path": "y"})]),
    ("recipe", RecipeBuilder().tool("t").tool("sum").map_reduce("t", "sum", items_ref="list.output.files", key="f", reduce_key="all"), {}, [
        Node("item_each", "t", {"f": {"$item": ""}}, for_each=ValueRef("list", ("files",))), Node("item_reduce", "sum", {"all": {"$ref": "item_each.output"}}),
    ]),
    ("recipe", RecipeBuilder().tool("t").param("who").param("n", 2).fan_out("t", [{"$param": "who"}, {"$param": "n"}]), {"who": "me"}, [Node("item_1", "t", "me"), Node("item_2", "t", 2)]),
    ("recipe", RecipeBuilder().tool("t").tool("u").pipeline(("t", {"a": 1}), ("u", {"b": {"$prev": ""}}), ("u", {"c": {"$prev": "x.y"}})), {}, [
        Node("step_1", "t", {"a": 1}), Node("step_2", "u", {"b": {"$ref": "step_1.output"}}), Node("step_3", "u", {"c": {"$ref": "step_2.output.x.y"}}),
    ]),
]


@pytest.mark.parametrize(("kind", "builder", "params", "nodes"), GOLDEN)
def test_golden_lowerings(kind, builder, params, nodes):
    doc = builder.build()
    assert check_document(kind, doc) is None
    lowered = compile_intent(doc) if kind == "intent" else compile_recipe(doc, params)
    assert list(lowered.nodes) == nodes and lowered.name == doc.get("name")
    assert lowered == builder.compile(**params) and check_document("plan", dump(lowered)) is None


def test_documents_that_schemas_refuse():
    for kind, doc in (("plan", {}), ("plan", {"version": "0", "nodes": [{"id": "a"}]}), ("plan", {"version": "0", "more": 1}), ("intent", {"version": "0", "steps": {}}), ("recipe", {"version": "0", "recipe": {"kind": "loop"}}), ("plan", {"version": "0", "tools": {"t": {"adapter": "a", "limits": {"batch_size": 0}}}})):
        assert check_document(kind, doc)
    refused("missing_param", RecipeBuilder().tool("t").param("who").fan_out("t", [{"$param": "who"}]).compile)
    refused("unknown_field", lambda: IntentBuilder().tool("t", "local", sure=True))


def test_builders_of_nodes_and_capabilities():
    assert fan_out("t", [1, {"a": 2}], "n") == [Node("n1", "t", 1), Node("n2", "t", {"a": 2})]
    got = capabilities(read={"reads": ["x"], "cost": Cost(5), "input_schema": {"type": "object"}}, other={})
    assert got["read"].effects == Effects(reads=("x",)) and got["read"].cost.fixed_ms == 5 and got["read"].input_schema and got["other"] == Capability()


def test_plans_run_by_the_command_line():
    b = PlanBuilder().tool("const", "local", pure=True).node("a", "const", {"value": 3}).output("o", "a.output")
    assert run_by_cli(b.build())["outputs"] == {"o": 3}
    assert run_by_cli(dump(b.build()), command="validate")["valid"]
    with pytest.raises(PlanError, match="version"):
        run_by_cli({"version": "9"})


def test_effects_reach_catalyst(spark):
    for effects, stays in ((Effects(pure=True), True), (Effects(reads=("clock",)), False), (None, False)):
        assert as_column_function(lambda x: x, "int", effects).deterministic is stays


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["t", "u"]), st.booleans(), st.sets(st.sampled_from("xyz"), max_size=2), st.sets(st.sampled_from("xyz"), max_size=2), st.booleans()), max_size=12))
def test_members_of_a_layer_are_compatible(own):
    """Each two may run side by side, and a node waits only if one that started earlier keeps it."""
    effects = {f"n{k:02d}": NodeEffects(tool, declared, Effects(pure=declared and not r and not w, reads=tuple(sorted(r)), writes=tuple(sorted(w)), commutative=c)) for k, (tool, declared, r, w, c) in enumerate(own)}
    layers = layered({n: set() for n in effects}, effects)
    assert sorted(n for x in layers for n in x) == sorted(effects)
    left = sorted(effects)
    for layer in layers:
        taken = []
        for n in left:
            if all(compatible(effects[n], effects[m]) for m in taken):
                taken.append(n)
        assert layer == taken
        left = [n for n in left if n not in taken]
