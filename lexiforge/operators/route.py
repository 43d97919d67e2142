"""Query planning and routing: clauses, signals, track decisions, terms, relatedness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .state import CJK

#: Clause boundaries, what is stripped off clauses, and limits.
CLAUSE_SPLIT = r"[？?；;。!！]|，|、|并且|以及|还有|同时|分别"
CLAUSE_STRIP = " 　，。？?"
MIN_CLAUSE, MAX_CLAUSES, LONG_QUESTION, CJK_RATIO = 4, 4, 40, 0.30
#: Keywords, question markers and greetings.
RELATED = (
    "这篇", "那篇", "论文", "文章", "资料", "文档", "文献", "第", "节", "章", "作者", "公式", "表", "图", "页", "摘要", "引言", "实验", "结果", "方法",
    "指标", "数据集", "定义", "定理", "证明", "模型", "架构",
)
MARKERS = ("?", "？", "什么", "如何", "怎么", "为什么", "为何", "多少", "几", "是否", "区别", "比较", "解释", "讲一下", "说说")
GREETINGS = ("你好", "您好", "hi", "hello", "谢谢", "感谢", "在吗", "早上好", "晚上好", "再见")
#: Fixed value: how users ask to have something remembered.
REMEMBER = (
    r"(?i)(请?记住|帮我记住|给我记住|要记住|记一下|记下来|记下|记牢|记着|别忘了|别忘记|以后都|之后都|每次都|下次都|永远都|"
    r"remember (this|that)|keep (this|that) in mind|always (use|answer|reply))"
)
#: Chinese terms with the English ones of the documents.
TERMS = {
    "注意力机制": "Attention", "注意力": "Attention", "自注意力机制": "Self-Attention", "自注意力": "Self-Attention", "多头注意力": "Multi-Head Attention",
    "缩放点积注意力": "Scaled Dot-Product Attention", "点积注意力": "Scaled Dot-Product Attention", "编码器": "Encoder", "解码器": "Decoder",
    "编解码器": "Encoder-Decoder", "位置编码": "Positional Encoding", "位置前馈网络": "Position-wise Feed-Forward Network",
    "前馈网络": "Feed-Forward Network", "前馈": "Feed-Forward", "残差连接": "Residual Connection", "层归一化": "Layer Normalization",
    "归一化": "Normalization", "子层": "sub-layer", "层数": "number of layers", "堆叠": "stack", "训练数据": "Training Data", "训练集": "training set",
    "测试集": "test set", "验证集": "development set", "训练时间": "Training Time", "训练步数": "training steps", "批量": "Batching", "批次": "batch",
    "硬件": "Hardware GPU", "显卡": "GPU", "学习率": "learning rate", "优化器": "optimizer", "超参数": "hyperparameters", "词表": "vocabulary",
    "词汇表": "vocabulary", "检查点": "checkpoint", "标签平滑": "label smoothing", "丢弃": "dropout", "束搜索": "beam search", "解码": "decoding",
    "推理": "inference", "微调": "fine-tuning", "参数量": "parameters", "模型规模": "model size", "基座模型": "base model", "基础模型": "base model",
    "大模型": "big model", "BLEU": "BLEU", "准确率": "accuracy", "精确匹配": "Exact Match", "分数": "score", "平均值": "average", "基准": "benchmark",
    "数据集": "dataset", "任务": "task", "检索增强生成": "Retrieval-Augmented Generation", "检索器": "retriever", "检索": "retrieval",
    "段落": "passage", "生成": "generation", "无条件": "unconditional", "条件": "conditional", "交叉验证": "cross-validation",
    "十折交叉验证": "10-fold cross-validation", "三元组": "triplet", "语义相似度": "semantic textual similarity",
    "语义文本相似度": "semantic textual similarity", "句子嵌入": "sentence embedding", "自然语言推理": "natural language inference",
    "迁移学习": "transfer learning", "零样本": "zero-shot", "表格": "table", "图": "figure", "图表": "chart", "公式": "equation", "引用": "citation",
    "章节": "section", "页": "page", "编码": "encoding",
}


def clauses(q: Column) -> Column:
    """The question's clauses, at most MAX_CLAUSES; none unless two or more survive."""
    parts = F.transform(F.split(q, CLAUSE_SPLIT), lambda c: F.btrim(c, F.lit(CLAUSE_STRIP)))
    kept = F.filter(parts, lambda c: (F.length(c) >= MIN_CLAUSE) & (c != q))
    return F.when(F.size(kept) >= 2, F.slice(kept, 1, MAX_CLAUSES)).otherwise(F.array().cast("array<string>"))


def wants_plan(q: Column, previous_empty: Column) -> Column:
    return (F.size(clauses(q)) >= 2) | q.rlike(r"\d") | (F.length(F.trim(q)) >= LONG_QUESTION) | (previous_empty > 0)


def cjk_ratio(q: Column) -> Column:
    """Share of CJK characters among those that are not space."""
    solid = F.regexp_replace(q, r"[\s　]", "")
    n = F.length(F.regexp_replace(q, r"\s", ""))
    cjk = n - F.length(F.regexp_replace(F.regexp_replace(q, r"\s", ""), CJK, ""))
    return F.when(F.length(solid) + n > 0, cjk / n).otherwise(F.lit(0.0))


def track(q: Column, previous_empty: Column) -> Column:
    """direct or planned by rule; a CJK question with a literal is planned."""
    guarded = (cjk_ratio(q) >= CJK_RATIO) & q.rlike(r"[0-9A-Za-z]")
    return F.when(wants_plan(q, previous_empty) | guarded, "planned").otherwise("direct")


def english(q: Column) -> Column:
    return F.when(~q.rlike(r"[^\x00-\x7F]"), q).otherwise(F.lit(""))


def dense_texts(q: Column) -> Column:
    """Question, clauses and English rendering without blanks and repeats, first seen first."""
    texts = F.concat(F.array(q), clauses(q), F.array(english(q)))
    return F.array_distinct(F.filter(F.transform(texts, F.trim), lambda t: t != ""))


def terms(spark: SparkSession) -> DataFrame:
    """(source, target, place) in the order of matching: longest first, then as listed."""
    rows = sorted(((k, v, i) for i, (k, v) in enumerate(TERMS.items())), key=lambda r: -len(r[0]))
    return spark.createDataFrame([(k, v, n) for n, (k, v, _) in enumerate(rows)], "source string, target string, place int")


def matched_terms(questions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, target, place): terms whose source is in the text, each target once.

    The term table is fixed and small, so it is broadcast to a nested loop."""
    t = terms(questions.sparkSession)
    hits = questions.join(F.broadcast(t), F.contains(F.col(text), F.col("source")))
    return hits.groupBy(key, "target").agg(F.min("place").alias("place"))


def is_related(q: Column, has_collection: Column, names: Column) -> Column:
    low = F.lower(q)
    greeting = (F.length(F.trim(low)) <= 12) & F.exists(F.array(*map(F.lit, GREETINGS)), lambda g: F.startswith(F.trim(low), g))
    named = F.exists(names, lambda n: (n != "") & F.contains(low, F.lower(n)))
    keyword = F.exists(F.array(*map(F.lit, RELATED)), lambda k: F.contains(q, k))
    asks = (F.length(F.trim(q)) >= 4) & F.exists(F.array(*map(F.lit, MARKERS)), lambda m: F.contains(low, m))
    return has_collection & ~greeting & (named | keyword | asks)


def plan_of(raw: Column) -> Column:
    """A model's JSON plan: fences off, from the first brace to the last, at most four sub-queries."""
    body = F.regexp_extract(F.regexp_replace(raw, r"```[a-z]*", ""), r"(?s)(\{.*\})", 1)
    parsed = F.from_json(body, "subqueries array<string>, english_query string")
    return F.struct(F.slice(F.coalesce(parsed["subqueries"], F.array().cast("array<string>")), 1, MAX_CLAUSES).alias("subqueries"), F.coalesce(parsed["english_query"], F.lit("")).alias("english_query"))


def signature(tool: Column, arguments: Column) -> Column:
    """tool and its arguments as JSON with sorted keys."""
    pairs = F.array_sort(F.map_entries(F.from_json(arguments, "map<string,string>")))
    return F.concat(tool, F.lit(":"), F.to_json(F.map_from_entries(pairs)))


def first_seen(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)
