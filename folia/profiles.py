"""Domain vocabulary used by the operators.

Every operator takes its markers, weights and caps from a ``Profile`` so one set of
operators can serve several corpora.  ``REGULATORY_ZH`` carries the values of the
Chinese regulatory corpus; ``WEB`` is the same vocabulary with link mentions for web pages.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --- Fixed values: whitespace and line ends as Python's str methods define them ----------
WS_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# --- Fixed values: text patterns ---------------------------------------------------------
MATCH_CHARS = r"[0-9A-Za-z\u4e00-\u9fff]+"
KEYWORD_TOKEN = r"[A-Za-z0-9\u4e00-\u9fff]{2,}"
TOKEN = rf"[{WS}]+|[\u4e00-\u9fff]|[A-Za-z0-9_]+|[^{WS}]"
TERM = r"[\p{L}\p{N}_-]{3,}"
HEADING = rf"(?md)^(#{{1,6}})[{WS}]+(.+?)[{WS}]*$"
MATH_BLOCK = rf"(?isd)```math[{WS}]*(.*?)```|\$\$(.*?)\$\$"
TABLE_LINE = rf"(?md)^[{WS}]*\|.+\|[{WS}]*$"
ARTICLE_AT_START = r"^第[一二三四五六七八九十百千万零两\d]+条"
CLAUSE_AT_START = r"^[（(][一二三四五六七八九十百千万零两\d]+[）)]"
ARTICLE_IN_QUERY = r"第[一二三四五六七八九十百零〇\d]+条"
RULE_NO = r"规则第(\d+)号"
ATTACHMENT_NO = r"附件(\d+(?:-\d+)?)"
NOTICE_TOPIC = r"关于(.+?)的通知"
FILENAME_HINT = r"(规则第\d+号|第\d+号|附件\d+(?:-\d+)?)"
CATALOG_COUNT = (
    r"(?:多少|几|总共|一共|共有|总数|合计).{0,10}"
    r"(?:号规定|号规则|个监管规则|项监管规则|条监管规则|个规定|项规定|条规定|个规则|项规则|条规则)"
    r"|(?:监管规则|规则清单|规则目录).{0,10}"
    r"(?:一共|总共|共有|总数|合计).{0,10}(?:多少|几)"
)
IMAGE_ONLY = rf"^(?:!\[[^\]]*\]\([^)]+\)[{WS}]*)+$"
LINK_ONLY = (
    rf"^(?:(?:\[[^\]]+\]\([^)]+\))|(?:https?://[^{WS}]+))"
    rf"(?:[{WS}]+(?:(?:\[[^\]]+\]\([^)]+\))|(?:https?://[^{WS}]+)))*$"
)
DOC_NUMBER_ONLY = r"^[A-Za-z\u4e00-\u9fff]{1,12}〔?\d{4}〕?\d+号$"
RECIPIENT_LINE = r"^各.+[：:]$"

# --- Fixed values: marker words ----------------------------------------------------------
OBLIGATION_MARKERS = ("应当", "不得", "可以", "负责", "报送", "披露", "编报", "提交")
THRESHOLD_MARKERS = ("上限", "下限", "阈值", "比例", "取值", "系数", "因子", "区间", "范围")
FOCUS_STOPWORDS = ("第一章", "第二章", "第三章", "第四章", "第五章", "第六章", "第七章", "第八章")
SUMMARY_METADATA_LABELS = (
    "发布日期", "来源", "原始链接", "标题", "标 题", "发文机关", "发文字号", "主题分类", "公文种类", "成文日期",
)
COMPARE_MARKERS = ("比较", "对比", "区别", "差异", "分别")
SUMMARY_MARKERS = ("主要内容", "概览", "概要", "总结", "介绍", "概括", "讲什么", "适用范围")
FORMULA_TYPE_MARKERS = ("公式", "计算", "系数", "因子", "阈值", "上限", "下限", "取值", "曲线", "表格")
VERSION_MARKERS = ("调整", "修订", "延长", "实施", "过渡期", "优化", "通知")
COMPLIANCE_MARKERS = ("应当", "是否需要", "要不要", "报送", "披露", "提交", "编报", "要求")
FORMULA_SEARCH_MARKERS = ("公式", "计算", "变量", "系数", "因子", "阈值", "上限", "下限", "取值", "曲线")
RELATION_SEARCH_MARKERS = (
    "关系", "通知", "调整", "修订", "延长", "过渡期", "优化", "附件", "影响", "对应", "按照", "哪一项规则", "计量",
)
COUNT_QUERY_MARKERS = ("多少", "几", "总共", "一共", "共有", "总数")
COUNT_SCOPE_MARKERS = ("规则", "规定", "附件", "通知")
SECTION_QUERY_MARKERS = (
    "公式", "条", "款", "表", "表格", "名单", "阶段", "曲线", "情景", "因子",
    "系数", "阈值", "上限", "下限", "比例", "取值", "定义", "怎么计算", "计算公式",
)
DOCUMENT_QUERY_MARKERS = ("主要内容", "主要涉及", "概览", "概要", "总结", "介绍", "概括", "讲什么", "适用范围")
HYBRID_QUERY_MARKERS = ("比较", "对比", "区别", "关系", "联系", "分别", "同时", "综合")
ADJUST_MARKERS = ("调整", "优化", "差异化", "调节")
EXTEND_MARKERS = ("延长", "过渡期", "实施")
CLARIFY_MARKERS = ("公式", "系数", "因子", "计量")
APPLY_MARKERS = ("按照", "适用", "根据", "参照", "计量")
SEMANTIC_RELATIONS = (
    "adjusts_rule", "extends_transition", "clarifies_formula", "applies_to_rule", "requires_attachment",
)
GENERIC_ALIASES = ("通知", "监管规则", "附件")
CATEGORY_HINTS = {"rules": "监管规则", "attachments": "附件", "notices": "通知"}
SOURCE_FOLDERS = {"偿二代二期-规则": "rules", "偿二代二期-附件": "attachments"}

FOLLOWUP_PREFIXES = (
    "那", "那它", "那这个", "那这些", "它", "这个", "这些", "该", "其", "前者", "后者", "再", "继续", "另外", "还有",
    "那么", "then", "what about", "how about", "and ", "also ", "what else", "compare that",
)
FOLLOWUP_TERMS = (
    "它", "这个", "这些", "那个", "上述", "上面", "前面", "刚才", "之前", "前者", "后者", "该规则", "该要求",
)
FOLLOWUP_WORDS = (
    "that", "those", "them", "it", "this", "these", "former", "latter", "above", "previous", "earlier",
)

STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "into", "is", "it", "of", "on",
    "or", "should", "that", "the", "their", "these", "this", "to", "use", "what", "when", "which", "with",
)

# --- Fixed values: routing tables --------------------------------------------------------
PLAN_STRATEGIES = {
    "locate": "title-first",
    "summary": "title-summary-document",
    "formula": "title-summary-section-formula",
    "comparison": "title-summary-hybrid",
    "catalog": "catalog-direct",
    "version": "title-summary-related-notices",
    "compliance": "title-summary-evidence",
    "analysis": "summary-hybrid",
}
EVIDENCE_STEPS = {
    "summaries": ("summary", "comparison", "version", "analysis", "locate"),
    "sections": ("formula", "compliance", "analysis", "version"),
    "formulas": ("formula",),
    "relations": ("version", "comparison"),
}
CATALOG_ANSWER_RULE = "目录统计类问题必须回到 manifest/目录元数据后再回答。"
EVIDENCE_ANSWER_RULE = "必须回到 summary/section/formula 原文证据后再回答；关系边只作为导航提示。"

# --- Fixed values: output phrases --------------------------------------------------------
REASON_CONTAINED = "文本直接覆盖查询"
REASON_GRAMS = "语义片段相关"
REASON_KEYWORDS = "关键词命中："
REASON_SCOPED = "已限定目标文档"
REASON_ARTICLE = "条文编号命中"
REASON_FORMULA_SECTION = "公式型 section"
REASON_FORMULA_QUERY = "公式查询"
REASON_DEFAULT = "ready_data 相关"

# --- Fixed values: domain vocabulary for reranking ---------------------------------------
DOMAIN_RULES = (
    {
        "keywords": (
            "actuarial", "actuary", "insurance", "underwriting", "pricing", "reserve", "reserving", "claims",
            "mortality", "annuity", "pension", "solvency", "ifrs17",
        ),
        "planner_hint": (
            "For actuarial and insurance questions, separate sub-queries across actuarial practice, "
            "insurance business process, model assumptions, and operational implications."
        ),
        "reflector_hint": (
            "Check whether the evidence covers actuarial context, insurance use case, material assumptions, "
            "and practical implementation consequences."
        ),
        "priority_terms": (
            "actuarial", "insurance", "underwriting", "pricing", "reserve", "pension", "mortality",
        ),
    },
    {
        "keywords": (
            "governance", "risk", "ethic", "ethics", "regulation", "regulatory", "compliance", "oversight", "audit",
            "accountability", "transparency", "bias", "fairness", "control", "controls",
        ),
        "planner_hint": (
            "For governance, risk, ethics, or regulation questions, create sub-queries that separate framework, "
            "risk categories, controls, oversight responsibilities, and monitoring or audit expectations."
        ),
        "reflector_hint": (
            "Check whether the evidence covers governance responsibilities, risk or bias concerns, controls, "
            "transparency, and auditability."
        ),
        "priority_terms": (
            "governance", "risk", "ethics", "regulation", "compliance", "oversight", "audit", "transparency",
            "bias", "controls",
        ),
    },
    {
        "keywords": (
            "ai", "artificial", "intelligence", "machine", "learning", "model", "models", "llm", "generative",
            "federated", "interpretable", "explainable",
        ),
        "planner_hint": (
            "For AI and model questions, prefer sub-queries that separate capability, limitations, deployment risks, "
            "and evaluation or validation guidance."
        ),
        "reflector_hint": (
            "Check whether the evidence covers the AI technique itself, limitations, validation expectations, "
            "and deployment or monitoring considerations."
        ),
        "priority_terms": (
            "ai", "model", "models", "machine", "learning", "generative", "validation", "monitoring",
        ),
    },
)
DEFAULT_PLANNER_HINT = (
    "Prefer sub-queries that separate the main topic, supporting evidence, implementation details, and constraints."
)
DEFAULT_REFLECTOR_HINT = (
    "Check whether the evidence covers the main topic, practical details, caveats, and any missing tradeoffs."
)

# --- Fixed values: LaTeX vocabulary ------------------------------------------------------
LATEX_CONTROL_WORDS = (
    "begin", "end", "leq", "geq", "lt", "gt", "times", "cdot", "operatorname", "mathrm", "mathbf", "mathit", "math",
    "text", "cases", "sqrt", "left", "right", "min", "max", "sum", "prod", "frac", "quad", "qquad", "dots", "cdots",
    "ldots", "in", "notin", "limits", "over", "under",
)
GREEK_VARIABLES = (
    "alpha", "beta", "gamma", "delta", "epsilon", "theta", "lambda", "mu", "rho", "sigma", "tau", "phi", "omega",
)
SINGLE_LETTER_NOISE = ("M", "C", "E", "X", "R", "F", "T")

# --- Fixed values: HTML main-content targets ---------------------------------------------
HTML_TARGET_TAGS = ("div", "article", "section", "main")
HTML_TARGET_IDS = (
    "wenzhang-content", "trs_editor", "trseditor", "article-content", "zoom", "zoomcon", "main-content",
)
HTML_TARGET_CLASSES = (
    "wenzhang-content", "trs_editor", "trseditor", "article-content", "article-body", "content-body",
    "detail-content",
)
HTML_FALLBACK_TAGS = ("article", "main", "body")
HTML_SKIP_TAGS = ("script", "style", "noscript")
HTML_NO_CONTENT = "<div><p>未能识别正文容器，请检查原始网页归档。</p></div>"

# --- Fixed values: front matter order ----------------------------------------------------
FRONT_MATTER_KEYS = (
    "title", "category", "source_type", "source_file", "source_url", "publish_date", "converted_engine",
    "converted_at",
)


@dataclass(frozen=True)
class Profile:
    """Patterns and caps that vary between corpora."""

    name: str
    doc_prefix: str = ""
    heading_cap: int = 8
    paragraph_cap: int = 8
    keyword_cap: int = 40
    focus_cap: int = 5
    summary_chars: int = 180
    summary_part_chars: int = 120
    edge_preview_chars: int = 260
    section_max_tokens: int = 1200
    window_tokens: int = 500
    window_overlap: int = 80
    embed_max_tokens: int = 6000
    section_embed_max_tokens: int = 1800
    top_k: int = 4
    doc_context_tokens: int = 120_000
    section_context_tokens: int = 16_000
    similarity_threshold: float = 0.0
    mention_patterns: dict = field(default_factory=lambda: {"rule": RULE_NO, "attachment": ATTACHMENT_NO})
    mention_labels: dict = field(default_factory=lambda: {"rule": "规则第{}号", "attachment": "附件{}"})
    # Patterns that find a document's own number in its title; None means the mention patterns.
    title_patterns: dict | None = None
    adjust_markers: tuple = ADJUST_MARKERS
    extend_markers: tuple = EXTEND_MARKERS
    clarify_markers: tuple = CLARIFY_MARKERS
    apply_markers: tuple = APPLY_MARKERS


REGULATORY_ZH = Profile("regulatory_zh", doc_prefix="Knowledge_Base_MarkDown/")
# Web prose: a document mentions another by a site-relative link to its first title word.
WEB = replace(
    REGULATORY_ZH,
    name="web",
    doc_prefix="corpus/",
    mention_patterns={"rule": r"\]\(/([^)\s]+)\)"},
    mention_labels={"rule": "/{}"},
    title_patterns={"rule": r"^(\S+)"},
    apply_markers=("thethe", "enen", "onon"),
)
# Caps of the catalog that is derived on the fly when no built catalog exists.
FALLBACK_CATALOG = replace(
    REGULATORY_ZH, name="fallback_catalog", heading_cap=6, paragraph_cap=3, summary_chars=140, keyword_cap=30
)
