"""Fixed values of the measures: patterns and terms for text quality, profiles, document types, details and OCR fixes."""

from __future__ import annotations

# Signals of text quality.
MOJIBAKE_SEQUENCE = "(?:[鐩綍绔鍏姝鏄鐨瀹鏂杩鎴搴閰瑙涓叧妯鍙鎶姟鍔卞彂]{2,}|[鈥聽銆€]{1,})"
MOJIBAKE_CHARACTER = "[鐩綍绔鍏姝鏄鐨瀹鏂杩鎴搴閰瑙涓叧妯鍙鎶姟鍔卞彂绯荤粺]"
MOJIBAKE_TOKENS = [
    "姗欑毊", "鍏ラ棬", "绮鹃€", "娑電洊", "鏋舵瀯", "鍘熺悊", "閮ㄧ讲", "鏂规", "妗堛€", "娓犻亾", "鎺ュ叆", "绯荤粺", "妯″瀷", "閰嶇疆", "瀹夊叏", "鎴愭湰", "鍙傝€", "鎵嬪唽", "淇℃伅", "鏉ユ簮", "瀹樻柟",
    "鏂囨。", "浠撳簱", "绀惧尯", "璋冪爺", "鐗堟湰", "閫傜敤", "鍙戝竷", "鏃堕棿", "鐢熸€", "鍏ㄦ櫙", "鍏紬", "鐭ヨ瘑", "缂栫▼", "杈呭姪", "鍑嗙‘", "娆㈣繋", "鍏虫敞", "鍙嶉", "棣堜氦", "閰嶅", "瑙嗛"]
OCR_CONFUSION = r"\b(?:All in Al|Al编程|Al工具|A时代|Al使用|Google Al)\b"
QR_MARKERS = ["qr", "qrcode", "二维码"]
IMAGE_QR = ["扫码", "二维码", "扫一[扫下]", r"QR\s*code", "qrcode", "添加.*(?:客服|助理|老师)", "免费领取", "体验卡", "长按识别", "全勤打卡", "退款"]
IMAGE_MARKETING = ["报名", "优惠", "限时", "特价", "原价", "现价", "核心权益", "学员专享", "背书", "合作伙伴", "排行榜", "榜单", "TOP", "限量名额", "立即购买", "立即报名", "sale", "discount"]
IMAGE_OPERATION = ["步骤", "操作", "设置", "配置", "界面", "页面", "按钮", "菜单", "工具", "平台", "网站", "APP", "后台", "管理", "截图", "如图", "下图", "点击", "选择", "输入", "保存", "安装", "部署", "导入", "导出", "step", "configure", "settings", "dashboard", "screenshot", "click", "select", "install"]
IMAGE_PROOF = ["收入", "年入", "播放量", "数据", "成绩", "案例", "成果", "订单", "转化率", "revenue", "income", "views", "followers", "conversion"]
IMAGE_EDUCATION = ["教程", "步骤", "操作", "设置", "配置", "如何", "怎么", "方法", "案例", "入门", "进阶", "工具"]
# Terms of text profiles.
TUTORIAL_TERMS = ["步骤", "操作", "设置", "配置", "教程", "如何", "怎么", "实操", "案例", "prompt", "提示词", "tutorial", "step", "guide", "how to", "setup", "workflow"]
MEETING_TERMS = ["会议", "讨论", "主持人", "嘉宾", "提问", "回答", "访谈", "meeting", "interview", "host", "guest", "speaker"]
NOTE_TERMS = ["笔记", "复盘", "心得", "思考", "总结", "note", "reflection", "summary"]
EBOOK_TERMS = ["目录", "第一章", "第二章", "前言", "附录", "chapter", "table of contents", "preface", "appendix"]
# Document types in their order, hints (value, type, score) and patterns (type, score, pattern, flags).
DOCUMENT_TYPES = ["report", "course", "transcript", "webpage", "ebook", "code"]
SOURCE_HINTS = [("subtitle_transcript", "transcript", 8), ("pdf_like", "report", 1)]
FORMAT_HINTS = [("subtitle_transcript", "transcript", 8), ("html", "webpage", 7), ("ebook", "ebook", 8), ("code", "code", 8)]
TYPE_PATTERNS = [
    ("code", 4, r"```(?:python|js|ts|javascript|json|bash|sh|yaml|yml)?\n|^\s*(?:def|class|import|const|let|function)\s+", "m"),
    ("ebook", 4, r"\b(?:chapter|table of contents)\b|目录|第[一二三四五六七八九十\d]+章", "i"),
    ("transcript", 4, r"\btranscript\b|^\s*\d{1,2}:\d{2}\b|访谈|字幕|主持人|嘉宾", "im"),
    ("course", 5, r"第\s*[一二三四五六七八九十\d]+\s*(?:课|讲)|学习目标|课程|练习[:：]|作业|lesson\s+\d+", "i"),
    ("report", 5, "报告|摘要|同比|环比|样本量|研究方法|市场规模|趋势|结论|白皮书|survey|report|findings", "i"),
    ("webpage", 4, "导航|首页|登录|注册|订阅|cookie|privacy|terms|购物车|阅读全文|上一篇|下一篇|breadcrumb", "i"),
]
# Details that must survive.
DETAILS = {
    "tool_or_platform": r"工具|平台|账号|后台|网站|插件|APP|API|GitHub|YouTube|Obsidian|MinerU|\b(?:tool|platform|account|dashboard|plugin|workflow)\b",
    "parameter": r"参数|字段|配置|阈值|限制条件|\b(?:threshold|retry_count|failure_reason|temperature|top_p|model|seed)\b|\b[a-zA-Z_][\w-]*\s*=\s*[^,\s，。]+",
    "link": r"https?://\S+|www\.\S+",
    "prompt": "提示词|prompt|指令",
    "code": r"```|`[^`]+`|\b(?:def|class|const|let|function|import)\b",
    "table": r"^\s*\|.+\|\s*$|<table\b",
    "number_or_metric": r"\d+(?:\.\d+)?\s*(?:%|GB|MB|KB|ms|s|元|次|个|天)?",
}
DETAIL_TYPES = {"operation_step": "operation_step", "tool_instruction": "tool_or_platform", "prompt": "prompt", "code": "code", "table": "table"}
STRICT_DETAILS = ["operation_step", "prompt", "code", "table"]
#: Block types whose removal loses no detail, and those where that holds whatever they say.
POLLUTION = ["transcript_filler", "footer", "qr_image", "empty", "refund_policy", "back_matter"]
# OCR fixes in their order, and where a table, a code block or an image counts.
OCR_FIXES = [
    (r"\bAll in Al\b", "All in AI"), (r"Al(?=[一-鿿])", "AI"), ("Al(?=工具|时代|使用|模型|编程|技术|应用|内容|创作|协作|问答|助手)", "AI"), (r"(?<![a-zA-Z])A(?=[一-鿿])", "AI"), ("Google Al Studio", "Google AI Studio"), ("YouTubeAl", "YouTube AI"), ("AIlinAI", "AI in AI")]
PARAMETER = r"\b(?:threshold|retry_count|failure_reason|temperature|top_p|model|seed)\s*=\s*[^,\s，。]+"
COVERAGE = {"pdf_like": (0.82, 0.72), "markdown_note": (0.86, 0.76), "generic_block": (0.88, 0.78)}
COVERAGE_OTHER = (0.80, 0.70)
GATES = ["conversion_integrity", "cleanup_safety", "splitting_integrity", "review_safety", "export_readiness"]
NEXT_ACTIONS = {
    "conversion_integrity": "inspect_or_rerun_conversion", "cleanup_safety": "update_cleaning_rules_or_review_pack", "splitting_integrity": "adjust_splitter_or_chunking", "review_safety": "validate_review_patch", "export_readiness": "block_export"}
# end of fixed values
