"""Labels, bands and texts that are shown for codes and numbers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# What codes are called.
TASK_STATUS = {"pending": "待执行", "processing": "执行中", "completed": "已完成", "failed": "失败"}
TASK_PROGRESS = {"pending": 0, "processing": 60, "completed": 100, "failed": 0}
TASK_TYPE = {"malicious": "恶意性检测", "impersonation": "仿冒域名检测"}
DATA_SOURCE = {"upload": "上传文件", "newDomain": "新注册域名"}
TERMS = {"码址": "域名"}
TRAINING_STATUS = {"pending": "idle", "training": "running", "paused": "paused", "stopped": "stopped", "completed": "completed", "failed": "failed"}
MAJOR_THREATS = ("供应链攻击", "漏洞利用", "勒索软件", "APT攻击")
GRAVE_THREATS = ("C2通信", "钓鱼攻击")
FIRST_PROFILE_VERSION = "actor_profile_v1"
PROFILE_VERSION_PREFIX = "apt_org:"
EVIDENCE_IOC = "与历史 IOC 域名 %s 具备相似特征"
EVIDENCE_TLD = "TLD 或结构模式相似"
EVIDENCE_KEYWORDS = "关键词重叠: "
REASON_MATCH = "该域名与 %s 历史 IOC 画像在域名关键词、字符串相似度或结构模式上存在相似性，建议作为疑似 %s 相关域名纳入重点监测。"
REASON_NONE = "该域名暂未与已知组织 IOC 画像形成稳定关联，建议作为未知来源疑似恶意域名纳入监测。"
UNNAMED_ORGANIZATION = "未知组织"
NOTICE_TOTALS = "本批次高风险域名数量：%d\n已形成组织关联的域名数量：%d"
NOTICE_GROUP = "【%s】(%d个)"
NOTICE_NONE = "暂无明显疑似关联组织。"
MATCH_TYPE = "相似度"
REGIONS = ("东亚", "南亚", "东欧", "中东", "北美", "北美洲", "南美洲", "非洲", "欧洲", "大洋洲", "东南亚", "中亚", "未知")


def mapped(c: Column, names: Mapping[str, object], default: object = None) -> Column:
    """The name of a code; the default, or null, for others."""
    out = F.lit(default)
    for code, name in reversed(names.items()):
        out = F.when(c == code, F.lit(name)).otherwise(out)
    return out


def category_label(category: Column) -> Column:
    """What a model's category is called; null for others."""
    return mapped(category, TASK_TYPE)


def usual_terms(text: Column) -> Column:
    """Texts with the usual words in place of older ones."""
    for old, new in TERMS.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def first_key(json: Column, *keys: str) -> Column:
    """The first value of these keys of a JSON object that isn't null."""
    return F.coalesce(*[F.get_json_object(json, f"$.{k}") for k in keys])


def confidence(score: Column) -> Column:
    """high from 0.8, medium from 0.5, low above 0, else none."""
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").when(score > 0, "low").otherwise("none")


def risk_level(score: Column) -> Column:
    """unknown for null, high from 0.8, medium from 0.5, else low."""
    return F.when(score.isNull(), "unknown").when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def event_type(threat: Column) -> Column:
    return F.when(F.trim(threat).isin(*MAJOR_THREATS), "major").otherwise("normal")


def severity(threat: Column) -> Column:
    return F.when(F.trim(threat).isin(*MAJOR_THREATS), 5).when(F.trim(threat).isin(*GRAVE_THREATS), 4).otherwise(3)


def eta_seconds(progress: Column, elapsed: Column, status: Column) -> Column:
    """The seconds left of a running training, from its progress in percent so far."""
    return F.when((status == "training") & (progress > 0) & (progress < 100) & (elapsed > 0), (100 - progress) / (progress / elapsed))


def similarity_text(score: Column) -> Column:
    """Four decimals; empty for 0 and less."""
    return F.when(score > 0, F.format_string("%.4f", score)).otherwise("")


def editable(source: Column, creator_name: Column, created_by: Column, user_name: str, user_id: int) -> Column:
    """Whether the user may edit a model: a custom one that names them by user name or id."""
    own = (creator_name == user_name) | (created_by == user_name) | (created_by.try_cast("long") == user_id)
    return (source == "custom") & F.coalesce(own, F.lit(False))


def profile_version(explicit: Column, updated_at: Column, update_time: Column) -> Column:
    """The version given, else one from the time or day of the last change, else the first version."""
    given = F.when(F.trim(explicit) != "", F.trim(explicit))
    return F.coalesce(given, F.concat(F.lit(PROFILE_VERSION_PREFIX), F.date_format(updated_at, "yyyyMMddHHmmss")), F.concat(F.lit(PROFILE_VERSION_PREFIX), F.date_format(update_time, "yyyyMMdd")), F.lit(FIRST_PROFILE_VERSION))


def evidence_lines(best_ioc: Column, tld_hit: Column, keywords: Column, summary: Column) -> Column:
    """What speaks for a match, as an array of lines; the summary if nothing else does."""
    terms = F.slice(F.filter(F.transform(keywords, lambda x: F.trim(x)), lambda x: x != ""), 1, 5)
    lines = F.array(
        F.when(best_ioc != "", F.format_string(EVIDENCE_IOC, best_ioc)),
        F.when(tld_hit, F.lit(EVIDENCE_TLD)),
        F.when(F.size(terms) > 0, F.concat(F.lit(EVIDENCE_KEYWORDS), F.array_join(terms, ", "))),
    )
    there = F.filter(lines, lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, there).otherwise(F.filter(F.array(summary), lambda x: x.isNotNull()))
