"""What a rule condition means, for comparison: Python itself, with the
operands of ``and``/``or`` taken eagerly and every error counted as no match.

The expression is rewritten so that eager operands sit in a tuple, checked for
forbidden parts lazily, and evaluated by the interpreter.
"""

from __future__ import annotations

import ast

ALLOWED = {
    f.__name__: f
    for f in (len, str, int, float, bool, abs, max, min, sum, any, all, list, dict, set, tuple)
}
NODES = (
    ast.Expression, ast.Constant, ast.Name, ast.BinOp, ast.UnaryOp, ast.Compare, ast.BoolOp,
    ast.IfExp, ast.List, ast.Dict, ast.Tuple, ast.Subscript, ast.Attribute, ast.Call, ast.Load,
    ast.Add, ast.Sub, ast.Mult, ast.Div, ast.FloorDiv, ast.Mod, ast.Pow, ast.Not, ast.USub, ast.UAdd,
    ast.Eq, ast.NotEq, ast.Lt, ast.LtE, ast.Gt, ast.GtE, ast.In, ast.NotIn, ast.And, ast.Or,
)


def _refuse(*_):
    raise ValueError("forbidden")


_FORBIDDEN = ast.parse("__refuse__()", mode="eval").body


class _Rewrite(ast.NodeTransformer):
    def visit(self, node):
        bad = not isinstance(node, NODES)
        if isinstance(node, ast.Attribute):
            bad = node.attr.startswith("_")
        if isinstance(node, ast.Compare):
            bad = any(not isinstance(op, NODES) for op in node.ops)
        if isinstance(node, (ast.BinOp, ast.UnaryOp)):
            bad = not isinstance(node.op, NODES)
        if isinstance(node, ast.Call):
            bad = not isinstance(node.func, ast.Name) or node.func.id not in ALLOWED
            if not bad:
                args = [self.visit(a) for a in node.args]
                func = ast.Name(f"__call_{node.func.id}__", ast.Load())
                return ast.Call(func, args, [])
        if isinstance(node, ast.Dict) and any(k is None for k in node.keys):
            bad = True
        if bad and isinstance(node, ast.expr):
            return _FORBIDDEN
        node = self.generic_visit(node)
        if isinstance(node, ast.BoolOp):
            name = "all" if isinstance(node.op, ast.And) else "any"
            values = ast.Tuple(node.values, ast.Load())
            return ast.Call(ast.Name(f"__call_{name}__", ast.Load()), [values], [])
        return node


def run(condition: str, context: dict) -> bool:
    try:
        tree = ast.fix_missing_locations(_Rewrite().visit(ast.parse(condition, mode="eval")))
        names = {f"__call_{k}__": f for k, f in ALLOWED.items()}
        scope = {"__builtins__": {}, "__refuse__": _refuse, **names, **context}
        return bool(eval(compile(tree, "<rule>", "eval"), scope))  # noqa: S307 - test oracle only
    except Exception:  # noqa: BLE001
        return False
