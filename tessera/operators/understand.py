"""Query understanding and lexical reranking: intents, families, routes, scores."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

# Scores of intents, families of chunk types, first route of each intent.
INTENT_SCORES = {"image_trace": 0.86, "ocr_audit": 0.86, "safety": 0.84, "troubleshooting": 0.84, "legal": 0.82, "procedure": 0.8, "overview": 0.78, "component": 0.76}
TYPE_FAMILY = {
    "product_overview": "overview", "component_description": "component", "assembly_steps": "procedure", "operation_guide": "procedure", "maintenance_guide": "procedure", "troubleshooting_qa": "troubleshooting",
    "safety_warning": "safety", "legal_statement": "legal", "parts_list": "component", "specification_table": "component", "general_info": "general", "metadata_image_path": "auxiliary", "aux_navigation": "auxiliary",
}
FAMILY_TYPES = {
    "component": ["component_description", "parts_list", "specification_table", "general_info"],
    "procedure": ["assembly_steps", "operation_guide", "maintenance_guide", "general_info"],
    "legal": ["legal_statement", "general_info"],
    "overview": ["product_overview", "general_info"],
    "safety": ["safety_warning", "general_info"],
    "troubleshooting": ["troubleshooting_qa", "general_info"],
    "auxiliary": ["metadata_image_path", "aux_navigation"],
}
ROUTES = {
    "component": (["primary"], ["component"]), "procedure": (["primary"], ["procedure"]), "legal": (["primary"], ["legal"]), "safety": (["primary"], ["safety"]), "troubleshooting": (["primary"], ["troubleshooting"]),
    "image_trace": (["auxiliary"], ["auxiliary"]), "ocr_audit": (["auxiliary"], ["auxiliary"]), "overview": (["primary", "support"], ["overview"]), "general": (["primary"], []),
}
# Markers of intents in the order in which they are asked, over text without white space.
INTENT_WORDS = {
    "image_trace": ["pic", "image", "figure", "diagram", "图片", "图示"],
    "ocr_audit": ["ocr", "source", "rawtext", "原文", "识别"],
    "safety": ["safety", "warning", "caution", "安全", "警告"],
    "troubleshooting": ["fault", "error", "broken", "repair", "故障", "排查"],
    "legal": ["warranty", "policy", "legal", "保修", "声明"],
    "procedure": ["howto", "how", "install", "replace", "setup", "如何", "步骤"],
    "overview": ["overview", "toc", "chapter", "目录", "概览"],
    "component": ["where", "button", "indicator", "port", "part", "按钮", "部件"],
}
# The markers of the older cascade, of safety, trouble, law, action, parts and scan errors.
SAFETY_WORDS = ["安全", "警告", "警示", "注意", "小心", "危险", "禁止", "防护", "防护装备", "个人防护装备", "佩戴", "宽松衣物", "围巾", "项链", "标识", "标签", "电源", "触电", "雷雨"]
TROUBLE_WORDS = ["故障", "异常", "原因", "排查", "解决", "维修", "损坏", "破损", "磨损", "不制冷", "不工作", "报警", "失灵"]
LEGAL_WORDS = ["保修", "法规", "声明", "责任", "政策", "支持与服务", "网站", "网址", "附录", "废弃", "回收", "报废", "环保"]
ACTION_WORDS = ["安装", "设置", "使用", "步骤", "切换", "更换", "拆卸", "调节", "启动", "停机", "操作", "加油", "加注", "混合", "清洁", "维护", "保养", "检查", "范围", "问题"]
PART_WORDS = ["部件", "接口", "位置", "按键", "按钮", "指示灯", "追踪灯", "配件", "滤清器", "吹风管", "喷口"]
OCR_WORDS = ["ocr", "识别", "截断", "缺失", "原文", "源数据", "英国用户"]
OCR_FLAGS = ["ocr_corruption", "possible_missing_content", "truncated_list", "header_missing", "ambiguous_image_binding"]
OLDER_WORDS = {
    "image_trace": ["图片", "图示", "配图", "对应图", "pic"],
    "ocr_audit": ["ocr", "原文", "源数据", "识别错误", "乱码", "截断", "缺失"],
    "safety": SAFETY_WORDS,
    "troubleshooting": TROUBLE_WORDS,
    "legal": ["保修", "法规", "声明", "责任", "政策", "支持与服务", "网站", "网址", "废弃", "回收", "报废", "环保"],
    "procedure": ["怎么", "如何", "步骤", "安装", "设置", "更换", "切换", "使用", "拆卸", "开启", "关闭", "调节"],
    "overview": ["目录", "概览", "章节", "哪些内容", "有哪些", "整章", "附录"],
    "component": ["是什么", "在哪", "位置", "接口", "按键", "按钮", "指示灯", "部件"],
}
LIGHT_STATES, LIGHTS = ["状态", "红色", "白色", "蓝色", "灯灭"], ["指示灯", "追踪灯", "状态指示灯", "后侧灯光", "内部灯"]
# Parts of chunk type names and the family that each stands for.
TYPE_MARKERS = {
    "auxiliary": ["metadata", "navigation", "image_path", "aux"],
    "overview": ["overview", "summary", "group"],
    "safety": ["safety", "warning", "caution", "ppe", "protection"],
    "legal": ["legal", "warranty", "regulation", "emissions"],
    "troubleshooting": ["troubleshooting", "fault", "problem", "prevention"],
    "procedure": ["step", "task", "install", "installation", "startup", "start", "stop", "fueling", "mix", "mixing", "operation", "adjustment", "cleaning", "maintenance", "service", "prevention", "requirement"],
    "component": ["component", "item", "device", "accessory", "part", "port", "button", "indicator", "label", "tube", "nozzle", "filter", "carburetor", "muffler", "needle"],
}
# Fixed values of the router: manuals named, customer service, its context, and words of a question to a manual.
MANUAL_NAMED = ["根据手册", "按照手册", "手册中", "说明书中", "根据说明书", "原文", "章节", "图示", "ocr", "according to the manual", "in the manual", "manual program"]
SERVICE_WORDS = [
    "商品", "订单", "下单", "付款", "支付", "退款", "退货", "换货", "退换货", "售后", "客服", "物流", "快递", "运费", "配送", "发票", "优惠券", "投诉", "赔偿", "补发", "补寄", "少发", "漏发", "包装破损", "质量问题", "详情页",
    "上门安装服务", "试用装", "七天无理由", "7天无理由", "customer service", "order", "shipping", "delivery", "invoice", "refund", "return", "coupon",
]
SERVICE_CONTEXT = ["我购买", "我收到", "你们家", "你们的商品", "申请售后", "联系售后", "联系平台", "上门人员", "安装人员", "检修人员", "维修人员", "额外收取", "收取费用", "承诺的", "该怎么处理"]
MANUAL_WORDS = [
    "如何", "怎么", "怎样", "是什么", "有哪些", "指什么", "作用", "功能", "步骤", "安装", "装入", "设置", "连接", "配对", "操作", "使用", "启动", "关闭", "调节", "拆卸", "更换", "清洁", "组装", "校准", "复位", "重置", "指示灯", "按钮",
    "按键", "接口", "部件", "参数", "规格", "故障", "排查", "安全", "警告", "how to", "how the", "how do", "how can", "how should", "what is", "what are", "what do", "what can", "what should", "what kinds", "what information",
    "please introduce", "if i need to", "when encountering", "difficult to", "first use", "install", "setup", "connect", "pair", "operate", "replace", "clean", "assemble", "button", "indicator", "component", "specification",
    "troubleshoot", "safety",
]
# What else a term may be called.
SYNONYMS = {
    "吹管": ["吹风管", "喷口"], "吹风管": ["吹管", "喷口"], "防护装备": ["个人防护装备", "听力防护", "眼部防护", "面罩", "工作靴"], "个人防护装备": ["防护装备", "听力防护", "眼部防护", "面罩", "工作靴"],
    "宽松衣物": ["衣物", "宽松", "围巾", "项链", "长发"], "警示标识": ["警示标签", "警告标识", "破损", "磨损"], "警示标签": ["警示标识", "警告标识", "破损", "磨损"], "加油": ["加注", "油箱", "加油操作"],
    "燃油混合": ["混合方法", "汽油", "机油", "1:50"], "混合": ["燃油混合", "混合方法"], "冷机启动": ["冷机", "启动"], "热机启动": ["热机", "启动"], "维护": ["清洁", "保养", "检查"], "空气滤清器": ["滤清器", "清洁", "维护"],
}
# Fixed values of query variants: words that are dropped, endings that are cut, and what an intent adds.
FILLERS, ENDINGS = ["怎么", "如何", "请问", "想问", "帮我", "一下", "这个", "这个是", "请问一下"], ["是什么", "在哪", "怎么用", "怎么看", "怎么办", "是什么图", "对应什么"]
VARIANT_WORDS = {"procedure": "步骤 安装 设置 使用", "component": "部件 位置 说明", "legal": "条款 保修 声明", "safety": "安全 注意 警告 电源", "troubleshooting": "故障 原因 排查 解决", "ocr_audit": "OCR 原文 识别错误 缺失"}
# Chunk types by earlier types and markers, in the order in which they are asked, for English and Chinese manuals.
AUX_TYPES = ["metadata_image_path", "aux_navigation"]
TYPES_EN = [
    ("legal_statement", ["legal_clause"], ["warranty", "copyright", "fcc", "compliance", "liability", "trademark"]),
    ("safety_warning", [], ["warning", "caution", "danger", "safety", "electric shock", "injury", "fire hazard"]),
    ("troubleshooting_qa", [], ["troubleshooting", "problem", "cause", "solution", "error code", "cannot", "does not work"]),
    ("parts_list", [], ["package contents", "parts list", "supplied accessories", "included", "contents of package"]),
    ("specification_table", ["table"], ["specification", "specifications", "rating", "dimension", "voltage", "model", "capacity"]),
    ("assembly_steps", [], ["install", "installation", "assemble", "assembly", "mount", "connect", "insert", "remove", "attach", "replace"]),
    ("maintenance_guide", [], ["clean", "cleaning", "maintenance", "store", "storage", "inspect", "lubricat", "filter", "service"]),
    ("operation_guide", ["procedure_step"], ["press", "select", "set", "start", "stop", "use ", "operate", "adjust", "configure"]),
    ("component_description", ["text_image_atomic", "feature_group"], ["location", "overview", "component", "button", "connector", "control", "feature"]),
    ("product_overview", ["section_summary"], ["introduction", "about this", "description", "general information"]),
]
TYPES_ZH = [
    ("safety_warning", ["safety_clause", "caution_clause"], ["安全", "警告", "危险", "禁止", "防护", "伤害", "佩戴"]),
    ("legal_statement", ["legal_clause"], ["保修", "法律", "声明", "版权", "fcc", "合规", "责任限制", "回收", "废弃"]),
    ("troubleshooting_qa", ["troubleshooting_case", "troubleshooting_condition", "troubleshooting_cause", "troubleshooting_problem", "troubleshooting_answer"], ["故障", "故障排除", "问题", "原因", "解决", "无法", "不能启动", "不工作"]),
    ("parts_list", [], ["零件清单", "部件清单", "配件清单", "装箱清单", "清单表格", "parts list"]),
    ("specification_table", ["table"], ["技术参数", "规格", "参数", "额定", "尺寸", "重量", "载重", "电池", "电压", "保险丝", "型号", "适用年龄"]),
    ("assembly_steps", [], ["组装", "安装", "装配", "固定", "插入", "连接", "拆卸", "接线", "充电步骤"]),
    ("maintenance_guide", [], ["维护", "保养", "清洁", "更换", "检查", "滤清器", "滤网", "火花塞", "润滑", "存放", "维修"]),
    ("operation_guide", ["procedure_step", "procedure_overview"], ["操作", "使用", "启动", "停止", "设置", "模式", "按键", "控制", "配对", "拍摄", "播放", "开关", "充电"]),
    ("product_overview", [], ["产品介绍", "概述", "简介", "目录", "适用范围", "说明书"]),
    ("component_description", ["text_image_atomic", "feature_group"], ["产品描述", "部件", "组件", "结构", "功能", "按钮", "接口", "外观", "图解", "位置", "标注"]),
]
# Critical groups: words that a question has all of, one of, and none of, and the group's terms.
CRITICAL = (
    (["冷机"], [], [], ["冷机"]),
    (["热机"], [], [], ["热机"]),
    (["加油"], [], [], ["加油", "加注", "油箱"]),
    (["燃油", "混合"], [], [], ["燃油混合", "混合方法", "1:50", "汽油", "机油"]),
    (["混合"], [], ["燃油"], ["混合", "1:50"]),
    ([], ["防护装备", "个人防护"], [], ["个人防护装备", "防护装备", "听力防护", "眼部防护", "面罩", "工作靴"]),
    ([], ["宽松", "衣物"], [], ["宽松", "衣物", "围巾", "项链", "长发"]),
    ([], ["警示", "标识", "标签"], [], ["警示标识", "警示标签", "警告标识", "标识", "标签"]),
    ([], ["吹管", "吹风管"], [], ["吹风管", "吹管", "喷口"]),
    ([], ["空气滤清器", "滤清器"], [], ["空气滤清器", "滤清器"]),
    ([], ["ocr", "缺失", "识别"], [], ["ocr", "缺失", "识别", "源数据"]),
)
SUMMARY_TYPES = ["procedure_overview", "product_overview", "section_summary"]
# Fixed values of X17: points of a term by field, of a chunk with none of them, of a picture id, and of a group in a heading, in a text or in neither.
FIELD_POINTS = {"title": 28.0, "section": 24.0, "index": 14.0, "text": 8.0, "pics": 14.0, "note": 8.0}
UNMET_POINTS = -28.0
PICTURE_POINTS = {("pics",): 120.0, ("title", "index", "text"): 80.0}
GROUP_POINTS = {("title", "section"): 55.0, ("index", "text"): 30.0, (): -60.0}


def _any(text: Column, words: list[str]) -> Column:
    """Whether a text holds one of the words; the text should be a plain column or bound by ``let``."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def _first(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    (test, name), *rest = cases
    return reduce(lambda acc, c: acc.when(*c), rest, F.when(test, name)).otherwise(otherwise)


def intent(text: Column) -> Column:
    """The first intent with a marker in the text without white space, else general."""
    found = lambda low: _first([(_any(low, words), name) for name, words in INTENT_WORDS.items()], "general")
    return X.let(X.normalize_text(F.coalesce(text, F.lit(""))), found)


def older_intent(text: Column) -> Column:
    """The older cascade: picture ids and Chinese markers; a question about the state of a light asks for a component."""

    def found(low: Column) -> Column:
        cases = [(_any(low, words), name) for name, words in OLDER_WORDS.items()]
        cases[0] = ((X.picture_id(text) != "") | cases[0][0], "image_trace")
        return _first([*cases[:2], (_any(low, LIGHT_STATES) & _any(low, LIGHTS), "component"), *cases[2:]], "general")

    return X.let(X.normalize_text(F.coalesce(text, F.lit(""))), found)


def intent_score(name: Column, with_picture_id: Column) -> Column:
    """The fixed score of an intent; a picture id makes an image query surer."""
    pairs = F.create_map(*(F.lit(v) for kv in INTENT_SCORES.items() for v in kv))
    return F.when((name == "image_trace") & with_picture_id, 0.98).otherwise(F.coalesce(F.try_element_at(pairs, name), F.lit(0.0)))


def family(chunk_type: Column) -> Column:
    """The family of a chunk type."""
    return F.try_element_at(F.create_map(*(F.lit(v) for kv in TYPE_FAMILY.items() for v in kv)), chunk_type)


def families(kind: Column, title: Column | None = None, section: Column | None = None, text: Column | None = None) -> Column:
    """The sorted families of a chunk, by its type, parts of its type's name, and markers in title, section and text.

    A chunk with a type but without any family is a subsection.
    """
    kind = X.strip(F.coalesce(kind, F.lit("")))
    said = X.normalize_text(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (title, section, text) if c is not None), F.lit("")))
    words = {"safety": SAFETY_WORDS, "troubleshooting": TROUBLE_WORDS, "legal": LEGAL_WORDS, "procedure": ACTION_WORDS, "component": PART_WORDS, "overview": ["目录", "概览", "附录"]}

    def found(s: Column) -> Column:
        by_name = [F.when(_any(s["name"], marks), F.lit(f)) for f, marks in TYPE_MARKERS.items()]
        by_text = [F.when(_any(s["hay"], marks), F.lit(f)) for f, marks in words.items()]
        return F.array_sort(F.array_distinct(F.array_compact(F.array(family(s["kind"]), *by_name, *by_text))))

    named = lambda s: X.let(found(s), lambda held: F.when((F.size(held) == 0) & (s["kind"] != ""), F.array(F.lit("subsection"))).otherwise(held))
    return X.let(F.struct(kind.alias("kind"), F.lower(kind).alias("name"), said.alias("hay")), named)


def classified_type(text: Column, earlier: Column | None = None, chinese: bool = False) -> Column:
    """The type of a chunk by its earlier types and the markers in its text, English and Chinese in their own orders.

    One auxiliary type alone stays as it is.
    """
    none = F.expr("cast(array() AS array<string>)")
    had = F.filter(F.coalesce(earlier, none), lambda t: t != "") if earlier is not None else none
    asked = TYPES_ZH if chinese else TYPES_EN
    found = lambda low: _first([(_any(low, words) | (F.arrays_overlap(had, X.strings(types)) if types else F.lit(False)), name) for name, types, words in asked], "general_info")
    kept = (F.size(F.array_distinct(had)) == 1) & F.get(had, F.lit(0)).isin(AUX_TYPES)
    return F.when(kept, F.get(had, F.lit(0))).otherwise(X.let(F.lower(F.coalesce(text, F.lit(""))), found))


def synonyms(terms: Column) -> Column:
    """X11: each term, then what it may also be called; a term is known by containing a key or, from three letters on, being part of one."""
    norm = X.normalize_text

    def more(term: Column) -> Column:
        own = norm(term)
        found = [F.when(own.contains(norm(F.lit(key))) | ((F.length(own) >= 3) & norm(F.lit(key)).contains(own)), X.strings(names)).otherwise(F.expr("cast(array() AS array<string>)")) for key, names in SYNONYMS.items()]
        return F.concat(F.array(term), *found)

    every = F.flatten(F.transform(F.filter(terms, lambda t: norm(t) != ""), more))
    seen = F.transform(every, norm)
    return F.filter(every, lambda t, i: F.array_position(seen, norm(t)) == i + 1)


def variants(text: Column, name: Column, terms: Column) -> Column:
    """The question, without its fillers, its terms, and its terms with what the intent adds; each once.

    An English question has itself and its terms.
    """
    question, joined = X.strip(F.coalesce(text, F.lit(""))), F.array_join(F.array_distinct(terms), " ")
    compact = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    bare = reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), FILLERS, compact)

    def without(ending: str) -> Callable[[Column], Column]:
        return lambda c: F.when(c.endswith(ending), F.left(c, F.length(c) - len(ending))).otherwise(c)

    for w in ENDINGS:
        bare = X.let(bare, without(w))
    spaced, some = F.array_join(terms, " "), F.size(terms) > 0
    pic = X.picture_id(text)
    more = [F.when((name == n) & some, F.concat(spaced, F.lit(" " + words))) for n, words in VARIANT_WORDS.items()]
    trace = name == "image_trace"
    more += [F.when(trace & (pic != ""), pic), F.when(trace & (pic != ""), F.concat(pic, F.lit(" 图片 对应"))), F.when(trace & (pic == "") & some, F.concat(spaced, F.lit(" 图片 配图")))]
    more.append(F.when((name == "general") & some, F.array_join(F.array_distinct(F.filter(terms, lambda t: F.length(X.normalize_text(t)) >= 2)), " ")))
    chinese = F.array(question, X.let(bare, lambda b: F.when(b != compact, b)), F.when(some, joined), *more)
    made = F.when(X.detect_language(text) == "en", F.array(question, F.when(some, joined))).otherwise(chinese)
    return F.array_distinct(F.filter(F.transform(F.array_compact(made), X.strip), lambda v: v != ""))


def ocr_candidate(terms: Column, title: Column, section: Column, index_text: Column, note: Column, flags: Column, tier: Column) -> Column:
    """whether a chunk stays for a question about scan errors: flagged, marked, or holding a term."""
    none, blank = F.expr("cast(array() AS array<string>)"), F.lit("")
    said = X.normalize_text(F.concat_ws(" ", *(F.coalesce(c, blank) for c in (title, section, index_text, note))))
    asked = F.transform(terms, X.normalize_text)
    held = X.let(said, lambda hay: _any(hay, OCR_WORDS) | F.exists(asked, lambda t: (t != "") & hay.contains(t)))
    return ~F.coalesce(tier.isin("auxiliary", "support"), F.lit(False)) & (F.arrays_overlap(F.coalesce(flags, none), X.strings(OCR_FLAGS)) | held)


def legal_candidate(terms: Column, title: Column, section: Column, kind: Column, tier: Column) -> Column:
    """whether a chunk stays for a legal question: a clause, a legal heading, or a heading with a legal term of the question."""
    blank = F.lit("")
    said = X.normalize_text(F.concat_ws(" ", F.coalesce(title, blank), F.coalesce(section, blank)))
    asked = F.filter(F.transform(terms, X.normalize_text), lambda t: _any(t, LEGAL_WORDS))
    held = X.let(said, lambda hay: _any(hay, LEGAL_WORDS) | F.exists(asked, lambda t: (t != "") & hay.contains(t)))
    return ~F.coalesce(tier == "auxiliary", F.lit(False)) & (F.coalesce(kind == "legal_clause", F.lit(False)) | held)


def trim_limit(name: Column) -> Column:
    """How many results an intent keeps; null for all."""
    return F.when(name == "ocr_audit", 1).when(name.isin("legal", "safety", "troubleshooting"), 3)


def chunk_types(families: Column) -> Column:
    """The chunk types of families, in order and each once; no family allows all."""
    types = F.create_map(*(v for k, t in FAMILY_TYPES.items() for v in (F.lit(k), X.strings(t))))
    return F.array_distinct(F.flatten(F.transform(families, lambda f: F.coalesce(F.try_element_at(types, f), F.expr("cast(array() AS array<string>)")))))


def routes(analyzed: DataFrame) -> DataFrame:
    """Rows (query_id, intent, doc) to routes, one a document, and an unscoped safety route for safety queries."""
    table = F.create_map(*(v for k, (tiers, families) in ROUTES.items() for v in (F.lit(k), F.struct(X.strings(tiers).alias("tiers"), (X.strings(families) if families else F.expr("cast(array() AS array<string>)")).alias("families")))))
    scoped = analyzed.select("query_id", "intent", "doc", F.try_element_at(table, F.col("intent")).alias("r")).select("query_id", "intent", "doc", "r.tiers", "r.families")
    extra = scoped.filter("intent = 'safety' AND doc IS NOT NULL").withColumn("doc", F.lit(None).cast("string"))
    return scoped.unionByName(extra).distinct()


def recallable(tier: Column) -> Column:
    """primary and support; null is not recallable."""
    return F.coalesce(tier.isin("primary", "support"), F.lit(False))


def legacy_base(score: Column) -> Column:
    """10 / (1 + score); written for distances, so a higher similarity lowers it."""
    return 10 / (1 + F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0)))


def critical_groups(query: Column) -> Column:
    """The groups of terms of which a fitting chunk has one; Chinese questions only."""
    empty = F.expr("cast(array() AS array<array<string>>)")

    def found(low: Column) -> Column:
        groups = empty
        for every, some, none, terms in CRITICAL:
            asked = _any(low, some) if some else F.lit(True)
            for w in every:
                asked = asked & low.contains(w)
            for w in none:
                asked = asked & ~low.contains(w)
            groups = F.concat(groups, F.when(asked, F.array(X.strings(terms))).otherwise(empty))
        return F.when(X.detect_language(low) == "en", empty).otherwise(groups)

    return X.let(X.normalize_text(F.coalesce(query, F.lit(""))), found)


def relevance(
    row_terms: Column, title: Column, section: Column, index_text: Column, text: Column, score: Column, name: Column, kind: Column, tier: Column, prefer_support: Column,
    query: Column | None = None, pic_ids: Column | None = None, flags: Column | None = None, note: Column | None = None, known: Column | None = None,
) -> Column:
    """The lexical relevance of a chunk: base, picture id, term and group points by field, intent and tier adjustments.

    ``pic_ids``, ``flags`` and ``known``, families found before, are arrays; a
    chunk without known families has those that X15 infers.
    """
    return X.let(_values(row_terms, title, section, index_text, text, score, name, kind, tier, prefer_support, query, pic_ids, flags, note, known), _relevance)


def _values(
    row_terms: Column, title: Column, section: Column, index_text: Column, text: Column, score: Column, name: Column, kind: Column, tier: Column, prefer_support: Column,
    query: Column | None = None, pic_ids: Column | None = None, flags: Column | None = None, note: Column | None = None, known: Column | None = None,
) -> Column:
    """The struct of prepared values that ``_relevance`` reads."""
    none, blank = F.expr("cast(array() AS array<string>)"), F.lit("")
    array = lambda c: none if c is None else F.coalesce(c, none)
    norm = lambda c: X.normalize_text(F.coalesce(blank if c is None else c, blank))
    inferred = families(kind, title, section, text)
    values = {
        "title": norm(title), "section": norm(section), "index": norm(index_text), "text": norm(text), "pics": norm(F.array_join(array(pic_ids), " ")), "note": norm(note), "asked": norm(query),
        "pic": norm(X.picture_id(blank if query is None else query)), "of": inferred if known is None else F.coalesce(known, inferred), "terms": F.filter(F.transform(F.coalesce(row_terms, none), norm), lambda t: t != ""),
        "groups": F.expr("cast(array() AS array<array<string>>)") if query is None else critical_groups(query), "base": legacy_base(score), "intent": F.coalesce(name, blank), "kind": F.coalesce(kind, blank), "low_kind": F.lower(F.coalesce(kind, blank)),
        "tier": F.coalesce(tier, blank), "support": prefer_support, "n_pics": F.size(array(pic_ids)), "n_flags": F.size(array(flags)), "noted": F.coalesce(blank if note is None else note, blank) != "", "n_terms": F.size(F.coalesce(row_terms, none)),
    }
    return F.struct(*(c.alias(k) for k, c in values.items()))


def asked_values(text: Column, terms: Column, name: Column) -> Column:
    """What X17 reads of a question: its terms, how many there were, its picture id and groups, its intent, and whether a general one names safety."""
    v = _values(terms, *(F.lit(None).cast("string") for _ in range(4)), F.lit(0.0), name, F.lit(""), F.lit(""), F.lit(False), query=text, known=F.expr("cast(array() AS array<string>)"))
    safe = lambda v: (v["intent"] == "general") & _any(v["asked"], SAFETY_WORDS)
    return X.let(v, lambda v: F.struct(v["terms"].alias("terms"), v["n_terms"].alias("n_terms"), v["pic"].alias("pic"), v["groups"].alias("groups"), v["intent"].alias("intent"), safe(v).alias("safe")))


def scanned_values(
    asking: list[tuple[str, bool]], title: Column, section: Column, index_text: Column, text: Column, kind: Column, tier: Column, prefer_support: Column, pic_ids: Column, flags: Column, note: Column
) -> Column:
    """What X17 and F5 read of a scanned chunk, which has no score of its own.

    The fields of ``FIELD_POINTS``; ``said``, what F5 searches for a question
    about scan errors; for each of ``asking``, an intent and whether a general
    question names safety, ``points``, X17 without the question's words, and
    ``kept``: 2 if F5 leaves the chunk, 1 if it takes a term in ``said``, else 0.
    """
    none, blank = F.expr("cast(array() AS array<string>)"), F.lit("")
    v = _values(none, title, section, index_text, text, F.lit(0.0), blank, kind, tier, prefer_support, pic_ids=pic_ids, flags=flags, note=note)
    ocr = F.when(ocr_candidate(none, title, section, index_text, note, flags, tier), 2).when(F.coalesce(tier.isin("auxiliary", "support"), F.lit(False)), 0).otherwise(1)
    legal = F.when(legal_candidate(none, title, section, kind, tier), 2).otherwise(0)  # a legal term in a heading brings its marker with it
    kept = [ocr if name == "ocr_audit" else legal if name == "legal" else F.lit(2) for name, _ in asking]
    said = X.normalize_text(F.concat_ws(" ", *(F.coalesce(c, blank) for c in (title, section, index_text, note)))) if any(name == "ocr_audit" for name, _ in asking) else blank

    def found(v: Column) -> Column:
        points = [X.let(v.withField("intent", F.lit(name)).withField("asked", F.lit(SAFETY_WORDS[0] if safe else "")), _relevance) for name, safe in asking]
        return F.struct(*(v[f].alias(f) for f in FIELD_POINTS), said.alias("said"), F.array(*points).alias("points"), F.array(*kept).alias("kept"))

    return X.let(v, found)


def _relevance(v: Column) -> Column:
    """``relevance`` of a struct of prepared values."""
    when = lambda condition, points: F.when(condition, float(points)).otherwise(0.0)
    has = lambda *names: F.arrays_overlap(v["of"], X.strings(list(names)))
    marked = lambda words, points: sum((when(v["title"].contains(w) | v["index"].contains(w), points) for w in words), F.lit(0.0))
    anywhere = lambda t, names: reduce(lambda a, b: a | b, (v[f].contains(t) for f in names))

    by_pic = F.when(v["pic"] != "", sum((when(anywhere(v["pic"], names), points) for names, points in PICTURE_POINTS.items()), F.lit(0.0))).otherwise(0.0)
    by_term = F.aggregate(v["terms"], F.lit(0.0), lambda total, t: total + sum((when(v[f].contains(t), points) for f, points in FIELD_POINTS.items()), F.lit(0.0)))
    unmet = when((v["n_terms"] > 0) & (F.size(v["terms"]) == v["n_terms"]) & ~F.exists(v["terms"], lambda t: anywhere(t, FIELD_POINTS)), UNMET_POINTS)
    heading, body, neither = GROUP_POINTS
    group = lambda g: F.when(F.exists(g, lambda t: anywhere(t, heading)), GROUP_POINTS[heading]).when(F.exists(g, lambda t: anywhere(t, body)), GROUP_POINTS[body]).otherwise(GROUP_POINTS[neither])
    by_group = F.aggregate(v["groups"], F.lit(0.0), lambda total, g: total + group(g))

    name = v["intent"]
    family_of = F.when(name == "image_trace", "auxiliary").when(name == "ocr_audit", "ocr").when(name.isin(*(INTENT_SCORES.keys() - {"image_trace", "ocr_audit"})), name)
    plain = name.isin("component", "procedure", "legal", "safety", "troubleshooting")
    target = F.when(family_of.isNull(), 0.0).when(F.array_contains(v["of"], family_of), 18.0).when(plain, -12.0).otherwise(0.0)
    clause = v["kind"] == "legal_clause"
    special = (
        F.when(name == "procedure", when(_any(v["low_kind"], ["step", "task", "install", "start", "fueling", "mix", "maintenance", "cleaning"]), 16) + marked(["安装", "设置", "使用", "步骤", "切换", "更换", "拆卸", "调节"], 8) + when(has("safety"), -30))
        .when(name == "component", marked(["部件", "接口", "指示灯", "位置", "按键", "按钮", "追踪灯", "状态", "红色", "白色", "蓝色"], 6) + when(has("safety", "troubleshooting"), -14))
        .when(name == "legal", when(clause, 35) + marked(["保修", "条款", "声明", "政策", "责任", "法规"], 8) + when(~clause & ~anywhere("保修", ("title", "section", "index", "text")), -30))
        .when(name == "safety", when(_any(v["low_kind"], ["safety", "warning", "caution", "ppe", "label"]), 18) + when(has("safety"), 24) + when(has("troubleshooting", "component"), -12))
        .when(name == "troubleshooting", when(has("troubleshooting"), 28) + when(has("safety"), -18))
        .when(name == "image_trace", when(v["tier"] == "auxiliary", 12) + when(v["kind"] == "metadata_image_path", 18) + when(v["n_pics"] > 0, 8))
        .when(name == "ocr_audit", when(v["n_flags"] > 0, 60) + when(v["noted"], 24) + when(v["title"].contains("ocr"), 36))
        .when(name == "overview", when(v["kind"].isin(*SUMMARY_TYPES) | (v["tier"] == "support"), 20))
        .when(name == "general", when(has("safety") & ~_any(v["asked"], SAFETY_WORDS), -18))
        .otherwise(0.0)
    )
    by_tier = F.when((v["tier"] == "support") & v["support"], 10.0).when((v["tier"] == "primary") & ~v["support"], 4.0).otherwise(0.0)
    return F.round(v["base"] + by_pic + unmet + by_term + by_group + target + special + by_tier, 6)


def routed(text: Column, has_images: Column | None = None, products: list[str] | None = None) -> Column:
    """whether a question may search the manuals.

    In order: nothing asked, no; an image or picture id, a product's name or a
    model's, or a manual named, yes; customer service words or context, no; else
    whether it has a word of a question to a manual.  A product name of Latin
    letters counts as a whole word.
    """

    def found(low: Column) -> Column:
        named = F.lit(False)
        for p in products or []:
            p = " ".join(p.lower().split())
            named = named | (low.rlike(rf"(?<![a-z0-9])\Q{p}\E(?![a-z0-9])") if p.isascii() else low.contains(p))
        picture = low.rlike(r"(?U)\bmanual\d+_[a-z0-9_]+\b")
        model = low.rlike(r"(?U)\b(?=[a-z0-9-]*[a-z])(?=[a-z0-9-]*\d)[a-z][a-z0-9-]{3,}\b")
        shown = F.lit(False) if has_images is None else F.coalesce(has_images, F.lit(False))
        yes = shown | picture | named | model | _any(low, MANUAL_NAMED)
        return F.when(low == "", False).when(yes, True).when(_any(low, SERVICE_WORDS + SERVICE_CONTEXT), False).otherwise(_any(low, MANUAL_WORDS))

    return X.let(F.lower(X.strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))), found)


def active_documents(hits: DataFrame, known: DataFrame) -> DataFrame:
    """hits of known documents; if that leaves a query none, all of its hits."""
    from pyspark.sql import Window as W

    marked = hits.join(known.select("doc", F.lit(1).alias("is_known")).distinct(), "doc", "left")
    marked = marked.withColumn("any_known", F.max("is_known").over(W.partitionBy("query_id")))
    return marked.filter("is_known = 1 OR any_known IS NULL").drop("is_known", "any_known")
