import pytest

from symlake.sources.java_extract import extract

BEAN = """package com.example.apps;

import javax.ejb.Singleton;
import javax.ejb.SessionBean;
import org.springframework.stereotype.*;

@Singleton
public class Bean implements SessionBean {

    private String name;

    public Bean() {
        this.name = "";
    }

    public String getName() {
        return name;
    }

    public void setName(String name) {
        this.name = name;
    }
}
"""
SERVICE = """package com.example.apps;

import com.example.apps.Bean;
import org.springframework.beans.factory.annotation.Autowired;

public class Service {

    @Autowired
    private Bean myBean;

    public void doStuff() {
        String n = myBean.getName();
    }

    public Bean createBean() {
        return new Bean();
    }
}
"""
S = "org.springframework.stereotype"
A = "com.example.apps"
BEAN_ROWS = [
    ("PACKAGE", A, A, "Module", 0), ("IMPORT", "javax.ejb.Singleton", "javax.ejb.Singleton", "Module", 2), ("IMPORT", "javax.ejb.SessionBean", "javax.ejb.SessionBean", "Module", 3), ("IMPORT", S + ".*", S + ".*", "Module", 4),
    ("ANNOTATION", "javax.ejb.Singleton", "Singleton", "Property", 6), ("CLASS", A + ".Bean", "Bean", "Class", 7), ("TYPE", A + ".Bean", "Bean", "Class", 7), ("IMPLEMENTS_TYPE", "javax.ejb.SessionBean", "Bean", "Class", 7),
    ("FIELD", S + ".String", "name", "Field", 9), ("TYPE", S + ".String", "name", "Field", 9), ("METHOD", A + ".Bean.Bean", "Bean", "Method", 11), ("METHOD", A + ".Bean.getName", "getName", "Method", 15), ("RETURN_TYPE", S + ".String", "getName", "Method", 15),
    ("METHOD", A + ".Bean.setName", "setName", "Method", 19), ("METHOD", A + ".Bean.setName(String)", "setName", "Method", 19), ("RETURN_TYPE", S + ".void", "setName", "Method", 19), ("TYPE", S + ".String", "setName", "Method", 19),
]
SERVICE_ROWS = [
    ("PACKAGE", A, A, "Module", 0), ("IMPORT", A + ".Bean", A + ".Bean", "Module", 2), ("IMPORT", "org.springframework.beans.factory.annotation.Autowired", "org.springframework.beans.factory.annotation.Autowired", "Module", 3),
    ("CLASS", A + ".Service", "Service", "Class", 5), ("TYPE", A + ".Service", "Service", "Class", 5), ("ANNOTATION", "org.springframework.beans.factory.annotation.Autowired", "Autowired", "Property", 7), ("FIELD", A + ".Bean", "myBean", "Field", 8), ("TYPE", A + ".Bean", "myBean", "Field", 8),
    ("METHOD", A + ".Service.doStuff", "doStuff", "Method", 10), ("RETURN_TYPE", A + ".void", "doStuff", "Method", 10), ("VARIABLE_DECLARATION", A + ".String", "n", "Variable", 11), ("TYPE", A + ".String", "doStuff", "Method", 11), ("METHOD_CALL", A + ".Bean.getName", "doStuff", "Method", 11),
    ("METHOD", A + ".Service.createBean", "createBean", "Method", 14), ("RETURN_TYPE", A + ".Bean", "createBean", "Method", 14), ("CONSTRUCTOR_CALL", A + ".Bean", "Bean", "Class", 15), ("TYPE", A + ".Bean", "createBean", "Method", 15),
]


def rows(source, location=None):
    found, errors = extract(source)
    assert errors == []
    return [(r.location, r.qualified_name, r.name, r.kind, r.line) for r in found if location in (None, r.location)]


def names(source, location):
    return [q for _, q, *_ in rows(source, location)]


@pytest.mark.parametrize("source,want", [(BEAN, BEAN_ROWS), (SERVICE, SERVICE_ROWS)])
def test_all_rows_of_a_source(source, want):
    assert sorted(rows(source)) == sorted(want)


def test_annotations_of_declarations():
    found = {(r.location, r.qualified_name): r.annotations for r in extract(BEAN)[0] + extract(SERVICE)[0]}
    assert found["CLASS", A + ".Bean"] == [{"qualified_name": "javax.ejb.Singleton", "elements": {}}]
    assert found["FIELD", A + ".Bean"][0]["qualified_name"].endswith("Autowired")


def test_fields_are_lost_behind_a_nested_class():
    source = "package p; class A { F f; void a() { f.x(); } class B { } void b() { f.x(); } }"
    assert names(source, "METHOD_CALL") == ["p.F.x", "p.f.x"]


def test_star_imports_give_candidates_and_hide_the_package():
    assert names("package p; import a.*; import b.*; class C extends D { }", "INHERITANCE") == ["a.D", "b.D"]
    assert names("package p; import a.*; class C { } class E extends C { }", "INHERITANCE") == ["a.C"]


def test_static_imports_count_as_types():
    assert names("import static a.B.c; import static a.B.*; class X { c f; }", "IMPORT") == ["a.B.c", "a.B.*"]
    assert names("import static a.B.c; class X { c f; }", "FIELD") == ["a.B.c"]


def test_arrays_varargs_generics_and_primitives():
    source = "package p; class A<T extends java.util.List<T>> { int[] xs; <T, U> void m(String[] a, int... b) throws E { } java.util.List<T[]> l; }"
    assert names(source, "FIELD") == ["p.int[]", "java.util.List"]
    assert names(source, "METHOD") == ["p.A.m", "p.A.<T,U>m(String[],int)"]
    assert names(source, "RETURN_TYPE") == ["p.void"]
    assert names(source, "TYPE") == ["p.A", "p.int[]", "p.String[]", "p.int", "p.E", "java.util.List"]


def test_nested_kinds():
    source = "package p; class A { enum E implements I { X; void m() { } } record R(@N int a) { void r() { } } @interface T { String v() default \"d\"; } interface J extends K { } class In { class Deep { } } }"
    assert [(n, k) for _, _, n, k, _ in rows(source, "CLASS")] == [("A", "Class"), ("E", "Enum"), ("J", "Class"), ("In", "Class"), ("Deep", "Class")]
    assert names(source, "CLASS") == ["p.A", "p.E", "p.A.J", "p.A.In", "p.A.In.Deep"]
    assert [(q, n) for _, q, n, *_ in rows(source, "IMPLEMENTS_TYPE")] == [("p.I", "I")]
    assert names(source, "METHOD") == ["p.E.m", "r"]
    assert names(source, "INHERITANCE") == ["p.K"]


def test_code_in_comments_and_texts_is_none():
    source = 'class A { /* new B(); */ String s = "new C()"; // foo();\n String t = """\n  new D(); "q" \\""" x\n  """; char c = \'"\'; }'
    assert names(source, "CONSTRUCTOR_CALL") == [] and names(source, "METHOD_CALL") == []


def test_calls():
    source = 'package p; class A { void m(Q q) { a.b\n .c(1, x -> q.d()).e(); this.f(); super.g(h()); "s".i(); q.j(new Z() { void k() { q.l(); } }); q.n(); } }'
    assert names(source, "METHOD_CALL") == ["a.b.c(1,x -> q.d()).e", "a.b.c", "p.Q.d", "p.this.f", "p.A.h", 'p."s".i', "p.Q.j", "p.q.l", "p.q.n"]


def test_annotation_elements():
    source = '@A(x = 1 + 2, y = {"first", "b"}) @B("v\\"q") @C({}) class K { @D(@E) int f; }'
    found = extract(source)[0]
    assert found[0].annotations == [{"qualified_name": "A", "elements": {"x": "1 + 2", "y": "first"}}, {"qualified_name": "B", "elements": {"value": 'v"q'}}, {"qualified_name": "C", "elements": {"value": "{}"}}]
    marks = {r.name: [a["qualified_name"] for a in r.annotations] for r in found if r.location == "ANNOTATION"}
    assert marks == {"A": ["A", "B", "C"], "B": ["A", "B", "C"], "C": ["A", "B", "C"], "D": ["D"], "E": ["E"]}


def test_statements_and_expressions():
    source = """class A { int m(Object o) throws Exception {
        for (int i = 0, j = n(); i < j; i++) { f(i < 3 ? a : b); }
        for (final X x : xs()) { }
        try (R r = open(); s) { } catch (E | G e) { e.p(); } finally { q(); }
        int k = (int) o.v() >> 2 >>> 1; k >>= w(); List<Map<String, Y>> l = new ArrayList<>(); int[] z = {t(), 2};
        if (o instanceof Foo && o instanceof Bar b) return switch (k) { case 1, 2 -> u(); default -> { yield y(); } };
        label: while (!(k < l.size())) { do { break label; } while (aa() > 0); }
        synchronized (this) { assert bb() : cc(); } Runnable rr = A::dd; Supplier<int[]> ss = int[]::new; var cl = String[].class;
        class Local { void ee() { } } throw new E(ff(), (a, b) -> { gg(); });
    } }"""
    called = [q.rpartition(".")[2] for q in names(source, "METHOD_CALL")]
    assert called == ["n", "f", "xs", "open", "p", "q", "v", "w", "t", "u", "y", "size", "aa", "bb", "cc", "ff", "gg"]
    assert [n for _, _, n, *_ in rows(source, "VARIABLE_DECLARATION")] == ["k", "l", "z", "rr", "ss", "cl"]
    assert "Foo" in names(source, "TYPE") and "Bar" not in names(source, "TYPE")
    assert names(source, "CLASS") == ["A", "Local"]


def test_broken_members_are_passed_over():
    found, errors = extract("package p; class A { void a() { x.y(; } int ok() { return z.w(); } ### void b() { } }")
    got = [r.qualified_name for r in found]
    assert errors and "p.A.ok" in got and "p.z.w" in got
