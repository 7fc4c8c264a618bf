"""Hand-written facts of thirty small libraries in two versions, one known change each.

A case is (old, new, kinds that must be public, whether all must be silent, header counter that must move).
Types: {name: (kind, size, {member: (type, offset)}, {base}, {method: slot}, {case: value})}.
Symbols: {linkage: (name, pretty, result, params)}.
"""

INT, LONG = 32, 64


def fn(name, result, *params, linkage=None):
    return {linkage or name: (name, f"{result} {name}({', '.join(params)})", result, list(params))}


def struct(size=64, members=None, bases=(), slots=None, cases=None, kind="class"):
    return (kind, size, members or {}, set(bases), slots or {}, cases or {})


XY = {"x": ("int", 0), "y": ("int", 32)}


def lib(types=None, symbols=None, bodies=None, macros=None):
    return {"types": types or {}, "symbols": symbols or fn("f", "void"), "bodies": bodies or {}, "macros": macros or {}}


CASES = {
    "c_field_added_end": (lib({"Point": struct(64, XY)}), lib({"Point": struct(96, XY | {"z": ("int", 64)})}), {"field_added_to_struct"}, None),
    "c_field_added_middle": (lib({"P": struct(64, XY)}), lib({"P": struct(96, {"x": ("int", 0), "w": ("int", 32), "y": ("int", 64)})}), {"field_added_to_struct", "member_offset_changed"}, None),
    "c_field_added_padding": (lib({"Pad": struct(64, {"a": ("char", 0), "b": ("int", 32)})}), lib({"Pad": struct(64, {"a": ("char", 0), "c": ("char", 8), "b": ("int", 32)})}), {"field_added_to_struct"}, None),
    "c_field_removed": (lib({"P": struct(96, XY | {"z": ("int", 64)})}), lib({"P": struct(64, XY)}), {"field_removed_from_struct"}, None),
    "c_field_type_changed": (lib({"P": struct(64, XY)}), lib({"P": struct(128, {"x": ("int", 0), "y": ("long", 64)})}), {"field_type_changed"}, None),
    "c_enum_case_added": (lib({"E": struct(32, cases={"RED": 0}, kind="enum")}), lib({"E": struct(32, cases={"RED": 0, "BLUE": 2}, kind="enum")}), {"enum_case_added"}, None),
    "c_enum_case_added_widening": (lib({"E": struct(32, cases={"A": 0}, kind="enum")}), lib({"E": struct(64, cases={"A": 0, "HUGE_C": 0x7FFFFFFFFF}, kind="enum")}), {"enum_case_added", "type_size_changed"}, None),
    "c_enum_case_removed": (lib({"E": struct(32, cases={"A": 0, "B": 1}, kind="enum")}), lib({"E": struct(32, cases={"A": 0}, kind="enum")}), {"enum_case_removed"}, None),
    "c_func_added": (lib(), lib(symbols=fn("f", "void") | fn("f_new", "int")), {"symbol_added"}, None),
    "c_func_removed": (lib(symbols=fn("f", "void") | fn("f_old", "int")), lib(), {"symbol_removed"}, None),
    "c_param_added": (lib(symbols=fn("f", "int", "int", "int")), lib(symbols=fn("f", "int", "int", "int", "int")), {"function_signature_changed"}, None),
    "c_param_type_changed": (lib(symbols=fn("f", "int", "int")), lib(symbols=fn("f", "int", "long")), {"function_signature_changed"}, None),
    "c_return_type_changed": (lib(symbols=fn("f", "int")), lib(symbols=fn("f", "long")), {"function_signature_changed"}, None),
    "c_param_constness": (lib(symbols=fn("f", "int", "char*")), lib(symbols=fn("f", "int", "const char*")), set(), None),
    "c_inline_body_changed": (lib(bodies={"twice": "v*2"}), lib(bodies={"twice": "v*2+7"}), set(), "inline_body_changed"),
    "c_macro_value_changed": (lib(macros={"a.h::BUF": "64"}), lib(macros={"a.h::BUF": "128"}), set(), "macro_value_changed"),
    "c_no_change": (lib({"P": struct(64, XY)}, bodies={"t": "1"}, macros={"a.h::B": "1"}), lib({"P": struct(64, XY)}, bodies={"t": "1"}, macros={"a.h::B": "1"}), set(), "none"),
    "cxx_base_class_added": (lib({"Derived": struct(64, XY, {"Base"})}), lib({"Derived": struct(96, XY, {"Base", "BaseNew"})}), {"base_class_changed"}, None),
    "cxx_data_member_added": (lib({"Counter": struct(32, {"n": ("int", 0)})}), lib({"Counter": struct(64, {"n": ("int", 0), "step": ("int", 32)})}), {"field_added_to_struct"}, None),
    "cxx_enum_class_case_added": (lib({"Mode": struct(32, cases={"Read": 0}, kind="enum")}), lib({"Mode": struct(32, cases={"Read": 0, "Append": 2}, kind="enum")}), {"enum_case_added"}, None),
    "cxx_made_polymorphic": (lib({"Box": struct(32, {"w": ("int", 0)})}), lib({"Box": struct(128, {"w": ("int", 64)}, slots={"area": 0, "~Box": 1})}), {"vtable_changed"}, None),
    "cxx_method_sig_changed": (lib(symbols=fn("Counter::bump", "void", linkage="_ZN7Counter4bumpEv")), lib(symbols=fn("Counter::bump", "void", "int", linkage="_ZN7Counter4bumpEi")), {"function_signature_changed"}, None),
    "cxx_nonvirtual_method_added": (lib(symbols=fn("C::inc", "void", linkage="_ZN1C3incEv")), lib(symbols=fn("C::inc", "void", linkage="_ZN1C3incEv") | fn("C::reset", "void", linkage="_ZN1C5resetEv")), {"symbol_added"}, None),
    "cxx_virtual_added_end": (lib({"S": struct(64, slots={"area": 0})}), lib({"S": struct(64, slots={"area": 0, "centroid": 1})}), {"vtable_changed"}, None),
    "cxx_virtual_added_middle": (lib({"S": struct(64, slots={"area": 0})}), lib({"S": struct(64, slots={"centroid": 0, "area": 1})}), {"vtable_changed"}, None),
    "cxx_virtual_removed": (lib({"S": struct(64, slots={"area": 0, "perimeter": 1})}), lib({"S": struct(64, slots={"area": 0})}), {"vtable_changed"}, None),
    "cxx_inline_method_body_changed": (lib(bodies={"V::norm1": "a+b"}), lib(bodies={"V::norm1": "b+a"}), set(), "inline_body_changed"),
    "cxx_template_body_changed": (lib(bodies={"clampv": "x<l?l:x"}), lib(bodies={"clampv": "x>l?x:l"}), set(), "inline_body_changed"),
    "cxx_pimpl_field_added": (lib({"W": struct(64, {"impl": ("Impl*", 0)})}), lib({"W": struct(64, {"impl": ("Impl*", 0)})}), set(), None),
    "cxx_no_change": (lib({"C": struct(64, XY, slots={"a": 0})}), lib({"C": struct(64, XY, slots={"a": 0})}), set(), "none"),
}


def tables(spark, side):
    """The fact tables of one side of all cases."""
    rows = {k: [] for k in ("symbols", "types", "members", "bases", "vslots", "enumerators", "definitions", "macros")}
    for case, sides in CASES.items():
        at = (case, "lib")
        data = sides[side]
        for t, (kind, size, members, bases, slots, cases) in data["types"].items():
            rows["types"].append((*at, t, kind, size, f"include/{case}.h"))
            rows["members"] += [(*at, t, m, ty, off) for m, (ty, off) in members.items()]
            rows["bases"] += [(*at, t, b) for b in bases]
            rows["vslots"] += [(*at, t, m, True, s) for m, s in slots.items()] or [(*at, t, "plain", False, None)]
            rows["enumerators"] += [(*at, t, n, v) for n, v in cases.items()]
        rows["symbols"] += [(*at, link, pretty, name, None, True, result, params) for link, (name, pretty, result, params) in data["symbols"].items()]
        rows["definitions"] += [(case, u, "a.h", u, "FunctionTemplate", "d", b) for u, b in data["bodies"].items()]
        rows["macros"] += [(case, k, v) for k, v in data["macros"].items()]
    at = "release_pair string, object string, "
    schemas = {
        "symbols": at + "linkage string, pretty string, pairing string, version string, is_function boolean, return_type string, params array<string>",
        "types": at + "type_id string, kind string, size_bits bigint, declared_in string",
        "members": at + "type_id string, name string, type_name string, offset_bits bigint",
        "bases": at + "type_id string, base string",
        "vslots": at + "type_id string, method string, is_virtual boolean, slot int",
        "enumerators": at + "type_id string, name string, value bigint",
        "definitions": "release_pair string, usr string, path string, name string, kind string, decl_fp string, body_fp string",
        "macros": "release_pair string, key string, value_fp string",
    }
    return {k: spark.createDataFrame(rows[k], s) for k, s in schemas.items()}
