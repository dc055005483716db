"""Default word lists. All are parameters of the functions that use them; names of persons are never part of them."""

# The words, suffixes and figures that the rules are defined by.
COLD_WORDS = ("哦", "嗯", "行吧", "随便", "算了", "呵", "懒得", "不想说", "滚", "别烦", "够了")
WARM_WORDS = ("[捂脸]", "[呲牙]", "[偷笑]", "[大哭]", "[心碎]", "[白眼]", "[强]", "[破涕为笑]", "[抱拳]", "[玫瑰]", "哈哈", "笑死", "没招", "牛逼", "草")
NEUTRAL_WORDS = ("好的", "知道了", "ok", "收到", "了解", "明白", "好叭", "okok")
HONORIFICS = ("老师", "导", "哥", "姐", "同学", "学长", "学姐", "学弟", "学妹", "主任", "教授")
TITLES = ("老师", "导")
PRAISE = ("太优秀了", "太厉害了", "太强了")
FORBIDDEN_MARK = "[旺柴]"
ASIDE = "（"
EMOTIONS = ("warm_reply", "cold_response", "joking", "angry", "sad", "neutral_ack")
TIME_WORDS = ("以前", "之前", "现在", "最近", "变化")

# What replies are held against.
REAL_LENGTH_MEAN, REAL_LENGTH_STD, REAL_EMOJI_RATE, REAL_COLD_RATE = 6.5, 31.2, 0.056, 0.066

# Generic references to people; names of persons are left out.
GENERIC_NAMES = (
    "我们", "他们", "大家", "所有人", "有人", "别人", "自己", "一个", "未知", "？", "我", "你", "他", "她", "它", "你们", "她们", "咱们",
    "我朋友", "你朋友", "男生朋友", "女生朋友", "我好朋友", "俺的好朋友", "你室友", "我室友", "你同学", "我同学", "你老师", "我老师",
    "男的", "女的", "那个男的", "那个女的", "小哥", "小牛马", "学长", "那个学长", "学姐", "学弟", "学妹",
    "同学", "朋友", "老师", "室友", "舍友", "领导", "班主任", "中国老师", "在的中国老师", "领导压力老师", "你们体育老师",
    "初中同学", "我初中同学", "拍摄的同学", "动拍摄的同学", "宣委", "大班宣委", "姐姐", "妹妹", "哥哥", "弟弟", "爸爸", "妈妈",
)

# Fact rules (category, predicate, patterns, patterns that forbid it); "re:" marks a regular expression.
FACT_RULES = (
    ("preference", "喜欢吃", ("爱吃", "喜欢吃", "好吃爱吃", "想吃", "太喜欢吃了", "喜欢吃", "最爱吃", "re:喜欢.*吃", "好想吃", "日思夜想的", "就爱吃", "都爱吃"), ("不爱吃", "不喜欢吃", "讨厌吃")),
    ("preference", "不喜欢吃", ("不爱吃", "不喜欢吃", "讨厌吃", "吃不惯", "没有很喜欢吃"), ()),
    ("preference", "喜欢喝", ("想喝", "喜欢喝", "爱喝", "re:想喝.*了"), ()),
    ("preference", "喜欢(审美)", ("re:我喜欢.*画风", "re:我.*喜欢.*风格", "喜欢修勾", "喜欢阿拉斯加", "喜欢抹茶", "喜欢逛这种", "太喜欢这个了", "我很喜欢这张", "喜欢这种", "我喜欢看", "re:喜欢.*文学", "re:喜欢.*文笔"), ("不喜欢",)),
    ("preference", "不喜欢(审美)", ("不喜欢", "我讨厌", "我不喜欢", "讨厌"), ()),
    ("emotion", "开心", ("开心", "哈哈", "笑死", "好玩", "很幸福", "太幸福", "好高兴"), ("不开心", "难过")),
    ("emotion", "难过/焦虑", ("难过", "伤心", "害怕", "焦虑", "担心", "紧张", "不开心", "想哭", "累趴", "崩溃", "[大哭]", "[心碎]", "[难过]", "不想干了", "我死了算了"), ()),
    ("emotion", "压力大", ("累趴", "太累了", "不想干了", "累死了", "忙死了", "太肝了", "顶不住", "绷不住"), ()),
    ("relationship", "喜欢某人", ("我喜欢", "暗恋", "re:对.*有好感", "视奸你", "挺喜欢你", "认识你真好", "挺喜欢跟你聊天", "爱你"), ()),
    ("relationship", "对关系的态度", ("re:谈恋爱.*会", "爱情", "恋爱", "男朋友", "女朋友", "在一起", "分手", "前任", "暧昧", "re:喜欢.*类型", "没有相爱的勇气", "玩儿不起", "事业不能给爱情让步"), ()),
    ("attitude", "对工作的评价", ("视频组", "劳务费", "草台班子", "未来可期", "工资", "拍摄", "剪辑", "推送", "云盘", "公众号"), ()),
    ("attitude", "对学业的评价", ("冯如杯", "考试", "上课", "法语", "GPA", "论文", "保研", "答辩", "必修", "选修"), ()),
    ("self_perception", "自我描述", ("我这个人", "re:我.*是.*的人", "re:我.*性格", "re:我.*比较", "re:我.*很", "re:我.*特别", "我双标", "我除非"), ()),
)

# Initials of common characters in names, for matching abbreviations.
INITIALS = {
    "赵": "z", "云": "y", "朋": "p", "鹏": "p", "余": "y", "可": "k", "言": "y", "蔡": "c", "宜": "y", "君": "j", "袁": "y", "孟": "m",
    "硕": "s", "谢": "x", "渣": "z", "焦": "j", "爱": "a", "家": "j", "李": "l", "佳": "j", "韵": "y", "张": "z", "王": "w", "刘": "l",
    "陈": "c", "杨": "y", "黄": "h", "周": "z", "吴": "w", "徐": "x", "孙": "s", "马": "m", "朱": "z", "胡": "h", "郭": "g", "何": "h",
    "高": "g", "林": "l", "罗": "l", "郑": "z", "梁": "l", "叶": "y", "唐": "t", "冯": "f", "于": "y", "董": "d", "萧": "x", "程": "c",
    "曹": "c", "邓": "d", "许": "x", "傅": "f", "沈": "s", "曾": "z", "彭": "p", "吕": "l", "苏": "s", "蒋": "j", "贾": "j", "丁": "d",
    "魏": "w", "薛": "x", "范": "f", "方": "f", "石": "s", "姚": "y", "谭": "t", "廖": "l", "邹": "z", "熊": "x", "金": "j", "陆": "l",
    "郝": "h", "孔": "k", "白": "b", "崔": "c", "康": "k", "毛": "m", "邱": "q", "秦": "q", "江": "j", "史": "s", "顾": "g", "侯": "h",
    "龙": "l", "万": "w", "段": "d", "雷": "l", "钱": "q", "汤": "t", "尹": "y", "黎": "l", "易": "y", "常": "c", "武": "w", "乔": "q",
    "贺": "h", "赖": "l", "龚": "g", "文": "w",
}

# What an annotator may say about a message and the one before it.
CONVERSATION_ROLES = ("response", "topic_opener", "deflecting", "ending", "escalation", "standalone")
CONTEXT_RELEVANCE = ("direct_answer", "deflecting", "topic_shift", "emotional_response", "acknowledgment")
