"""Labelled seed text for the residue models: the kinds of residue, and prose about such things.

These are the labels of the classifier; natural prose is learnt from the corpus. Most
lines come from small grammars of parts, so a model knows every joint of two parts;
the fixed lines are the public messages of common web servers, frameworks and proxies.
"""

from __future__ import annotations

from itertools import product

FIELDS_ZH = "公司名称 公司简称 股票代码 报告期 主营业务 主要产品 营业收入 净利润 毛利率 注册地址 联系人 联系电话 客户 供应商 产品名称 项目名称 日期 年份 金额 数量 比例 标题 正文 摘要 作者 姓名 城市 省份 行业 部门 职务 电话 邮箱 网址 编号 备注 内容 单位 地址 名称 说明 产品型号 规格型号 主营产品 客户名称 供应商名称 法定代表人 实际控制人 控股股东 成立日期 注册资本 经营范围 员工人数 总资产 报告日期 报告年度 起始日期 截止日期 合同编号 合同金额 甲方 乙方 姓名职务 手机号 邮政编码 银行账号 税号".split()
FIELDS_EN = "name title body date year amount total price company product address phone email customer user author content item value id number department region city summary description".split()
#: Unfilled places: {0} stands for a field. Names between template signs are one class of characters (see ``ngrams``), so any name is known.
SLOTS = (
    "{{{{{0}}}}}|{{{{ {0} }}}}|${{{0}}}|#{{{0}}}|{{{0}}}|{{%{0}%}}|{{% {0} %}}|<%{0}%>|<%= {0} %>|<{0}>|%({0})s|%({0})d|%{0}%|[[{0}]]|[[ {0} ]]|__{0}__|@@{0}@@|@{0}@|#{0}#|${0}$|{{0}}|{{1}}|{{2}}|%s|%d|"
    "【{0}】|［{0}］|【请填写{0}】|［请填写{0}］|[请填写{0}]|（请填写{0}）|【此处填写{0}】|［此处填写{0}］|（此处填写{0}）|[此处填写{0}]|（此处插入{0}）|【此处插入{0}】|[此处插入{0}]|（在此输入{0}）|【待填{0}】|（待填）|（待补充）|【待补充】|（待定）|【待定】|（略）|《{0}待补》|《{0}待定》|"
    "{0}待定|{0}待补充|{0}待填写|待填写{0}|待补充{0}|待定{0}|请填写{0}|请输入{0}|请选择{0}|此处填写{0}|此处插入{0}|示例{0}|某某{0}|××{0}|XX{0}|xx{0}|XXX|XXXX|xxx|×××|××××|＿＿＿|＿＿＿＿|___|____|_____|________|……|"
    "undefined|null|NULL|None|NaN|nil|N/A|#N/A|#REF!|#VALUE!|#DIV/0!|#NAME?|#NULL!|#NUM!|[object Object]|(null)|(none)|(blank)|(empty)|TBD|TBC|TODO|FIXME|[TBD]|[TODO]|TODO: {0}|TBD: {0}|TBD-{0}|TODO-{0}|"
    "[{0} here]|[insert {0}]|[insert {0} here]|insert_{0}_here|<insert {0}>|[Your {0}]|[your {0} here]|Enter {0} here|Your {0} here|<{0}待填>|<请填写{0}>"
).split("|")
LINES = (
    "{0}：null|{0}：undefined|{0}：NaN|{0}：None|{0}：N/A|{0}：____|{0}：＿＿＿|{0}：XXX|{0}：×××|{0}：……|{0}：/|{0}：待定|{0}：待填|{0}：待补充|{0}：示例{0}|{0}：请输入{0}|{0}：请填写|{0}：（请在此填写）|{0}：（空）|"
    "{0}: null|{0}: undefined|{0}: NaN|{0}: None|{0}: N/A|{0}: ____|{0}: TBD|{0}: XXX|{0}: (fill in)|{0}: N/A (fill in)|{0}: enter here|（模板）|（样本）|(template)|(sample)"
).split("|")
FILLER = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt.
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores.
Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit, sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem.
Quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur, vel illum qui dolorem eum fugiat quo voluptas nulla pariatur.
Temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet ut et voluptates repudiandae sint et molestiae non recusandae.
Itaque earum rerum hic tenetur a sapiente delectus, ut aut reiciendis voluptatibus maiores alias consequatur aut perferendis doloribus asperiores repellat.
The quick brown fox jumps over the lazy dog. the quick brown fox
"""
#: Words that people type where text should be; every two of them may meet.
FILLER_WORDS = "测试 样例 示例 占位 文字 内容 文本 占位文本 占位文字 占位符 示例文本 示例文字 测试文字 测试内容 测试数据 样例文本 一段文字 一段示例文本 这里是 此处为 此处省略 正文内容 内容待添加 内容内容 文字文字 在此输入正文 在这里填写内容 标题标题 阿斯顿 啊啊啊 哈哈哈 test testing sample asdf asdfgh qwe qwerty xxx aaa abc foo bar baz 123 1234 lorem ipsum dolor hello world".split()
#: Words that generators of sample Latin put together.
LATIN = "lorem ipsum dolor amet vestibulum pellentesque curabitur phasellus mauris nulla suspendisse aenean vivamus donec integer fusce praesent quisque sollicitudin ultricies tincidunt vehicula faucibus malesuada fames turpis egestas habitant morbi tristique senectus netus pulvinar sagittis elementum bibendum sodales venenatis condimentum dictum rhoncus viverra lacinia porttitor ornare accumsan commodo eleifend feugiat gravida hendrerit imperdiet interdum laoreet lectus libero ligula lobortis luctus maecenas mattis mollis nibh nunc odio orci pharetra placerat posuere pretium proin purus quam risus rutrum sapien scelerisque sem semper tellus tempus tortor ullamcorper urna varius velit vitae volutpat vulputate".split()
_PLACES = "您访问的页面 您请求的页面 您查看的页面 您要访问的页面 您查看的内容 您请求的资源 您访问的链接 您要找的内容 该页面 当前页面 此页面 本页面 页面 该内容 内容 该文章 文章 该链接 链接 文件 请求的文件 请求的资源 资源 商品信息 数据".split()
_GONE = "不存在 已不存在 不存在或已被删除 不存在或已删除 已被删除 已删除 已下线 已下架 已失效 已过期 已被移除 已迁移 找不到了 未找到 无法找到 无法显示 无法访问 无法打开 暂时无法访问 暂时无法打开 暂时无法显示 加载失败 加载中 正在加载 走丢了 为空".split()
_MACHINES = "系统 服务器 服务 网络 网关 数据库 接口 后台 程序 应用 请求 连接 页面 数据 站点".split()
_STATES = "繁忙 异常 错误 出错 出错了 内部错误 超时 请求超时 连接超时 连接失败 查询失败 加载失败 响应失败 故障 无响应 没有响应 拒绝访问 不可用 暂不可用 暂时不可用 维护中 正在维护 升级中 正在升级 开小差了 过载".split()
_TRY = "，请稍后再试|，请稍后重试|，请稍候再试|，请稍后访问|，请刷新页面|，请刷新重试|，点击刷新|，点击重试|，点击返回|，点击返回首页|，返回首页|，请返回首页|，请联系管理员|，请与管理员联系|，请检查网络|，请检查网络连接|，请检查地址|，请检查地址是否正确|，请检查网址是否正确|，请重新登录|，请重新加载|，请在几分钟后重试|！|。|".split("|")
_SCRIPTS = "JavaScript|JS|脚本|浏览器脚本|浏览器的 JavaScript|浏览器的脚本|浏览器 JavaScript 功能|脚本支持|Cookie|Cookies|浏览器的 Cookie|JavaScript 和 Cookie".split("|")
_ALLOW = "请启用 请开启 请打开 请允许 请先启用 请先开启 需要启用 需要开启 需要打开 需要允许 未启用 未开启 已禁用 禁用了 不支持 检测到您禁用了 检测到未启用 您的浏览器不支持 您的浏览器已禁用 您的浏览器未启用 当前浏览器不支持 浏览器不支持 浏览器禁用了 本站需要 本页面需要 本应用需要 此网站需要 如需访问请启用".split()
_AFTER = "后刷新|后重试|后继续|后继续浏览|后继续访问|后重新加载|后再访问|后刷新本页|后刷新页面|才能访问|才能正常访问|才能正常显示|才能浏览|才能运行|才能使用|，否则无法正常显示|，页面无法正常显示|，内容无法显示|，部分功能无法使用|，请在浏览器设置中启用|，请更换浏览器|，请升级浏览器|。|".split("|")
_OFF = "被禁用|已被禁用|被拦截|被屏蔽|未启用|未开启|已关闭|不可用".split("|")
_ON = "，请在设置中启用|，请在设置中开启|，请在设置中允许|，请在浏览器设置中开启|，请启用后重试|，请允许后重新加载|，请开启后刷新|，页面无法显示|。|".split("|")
_AGAIN = "后重新载入|后重新加载|后重试|后刷新|后继续|。|".split("|")
_FIND = "找不到|未找到|没有找到|无法找到|查无|查询不到|抱歉，找不到|对不起，没有找到".split("|")
_YOURS = "您请求的|您访问的|您要访问的|您查找的|请求的|指定的|相应的|对应的|该|此".split("|")
_THINGS = "页面|文件|资源|内容|地址|网页|记录|数据|链接|文章|文件 /|资源 /|页面 /".split("|")
_LOGIN = "请登录|请先登录|请登录后|请注册或登录后|请先登录或注册后|登录后|登录已过期|登录状态已失效|会话已过期|会话超时|身份验证失败|您尚未登录|您没有权限|您无权|没有权限|权限不足|拒绝访问|禁止访问|访问被拒绝|访问受限|您的访问被拒绝|您的访问已被拦截|请求已被拦截|您的 IP 已被限制|您的IP已被封禁|访问过于频繁|您的访问过于频繁|请求过于频繁|操作过于频繁".split("|")
_VIEW = "查看全文|查看更多|查看内容|继续查看|继续浏览|继续访问|访问该页面|访问此页面|查看该页面|查看此内容|，请重新登录|，请向管理员申请|，请联系管理员|，请稍后再试|，已被限制|，请完成验证|，请输入验证码|。|".split("|")
_CHECK = "正在检查您的浏览器|正在验证您的浏览器|正在验证您是否是真人|正在进行安全检查|正在进行安全验证|请完成安全验证|请完成人机验证|请完成验证|请拖动滑块完成验证|请输入验证码|请输入图中的验证码|验证您的身份|页面即将跳转|页面正在跳转|正在跳转|正在加载，请稍候|加载中，请稍候|加载中|请稍候|请稍等".split("|")
_CHECKED = "，请稍候|……|…|，验证后继续访问|以继续访问|后继续访问|后继续浏览|，完成后将自动跳转|，如果没有自动跳转，请点击这里|，如未自动跳转请点击此处|，若长时间无响应，请刷新页面|。|".split("|")
CODES = "400 Bad Request|401 Unauthorized|403 Forbidden|404 Not Found|404 Page Not Found|405 Method Not Allowed|408 Request Timeout|410 Gone|413 Payload Too Large|429 Too Many Requests|500 Internal Server Error|501 Not Implemented|502 Bad Gateway|503 Service Unavailable|503 Service Temporarily Unavailable|504 Gateway Timeout|504 Gateway Time-out|404 页面未找到|404 未找到|403 禁止访问|403 拒绝访问|500 服务器内部错误|500 内部错误|502 网关错误|503 服务不可用|504 网关超时|401 未授权".split("|")
_PAGES = "The page|This page|The page you requested|The page you are looking for|The requested URL|The requested page|The requested resource|The resource|The file|The document|This content|The link|This site".split("|")
_MISSING = "was not found|could not be found|cannot be found|was not found on this server|does not exist|no longer exists|does not exist or has been moved|has been removed|has been deleted|has been moved|is not available|is no longer available|is unavailable|is temporarily unavailable|cannot be displayed|isn't working|has expired|is under maintenance".split("|")
_SUBJECTS = "JavaScript|Javascript|JS|scripts|cookies|JavaScript and cookies|JS and cookies|JavaScript in your browser|cookies in your browser|scripts for this page".split("|")
_NEEDS = "Please enable|Please turn on|Please allow|You need to enable|You must enable|Enable|This site requires|This page requires|This app requires|This website needs|This application requires|Your browser does not support|Your browser has disabled|Your browser blocks|We noticed that you have disabled".split("|")
_TO = " to continue.| to view this page.| to view this site.| to run this app.| to use this site.| to proceed.| and reload the page.| and refresh.| and try again.|.|".split("|")
NOTICES = """
Access denied. You do not have permission to access this page.
Access to this resource on the server is denied!
You don't have permission to access this resource.
Forbidden. You are not authorized to view this page.
Error code: 404. Error code: 500. Error 404. Error 500. HTTP Error 503. HTTP Status 404. Request ID: 0000. Reference #00.0 Ray ID: 000
错误代码：404 错误代码：500 错误码：502 错误编号：000 请求编号：000 （错误代码：500） (Error code: 500)
An error occurred while processing your request. An unexpected error has occurred. An internal error occurred.
Oops! Something went wrong. Sorry, something went wrong. Something went wrong. Please try again. Please try again later.
Sorry, we couldn't find that page. Sorry, an error occurred. Sorry for the inconvenience.
Back to home. Go back to the home page. Return to homepage. Go to homepage. Click here to go back.
The server encountered an internal error or misconfiguration and was unable to complete your request.
The server is temporarily unable to service your request due to maintenance downtime or capacity problems.
The server is busy. The server is too busy. The service is unavailable. Service temporarily unavailable. Server error.
We'll be back soon. Down for maintenance. Under construction. Coming soon.
Fatal error: Uncaught exception. Warning: Undefined variable. Traceback (most recent call last). NullPointerException at java.lang
Error establishing a database connection. Database connection failed. Connection refused. Connection timed out.
Checking your browser before accessing the site. This process is automatic. Your browser will redirect to your requested content shortly.
Verify you are human by completing the action below. Verifying you are human. This may take a few seconds. Just a moment...
Please wait while we verify your browser. Please wait while your request is being verified. Please complete the security check.
Complete the captcha to continue. Please enter the characters you see below. Are you a robot? Unusual traffic from your network.
Your access has been temporarily blocked. Your IP has been blocked. You have been blocked. Too many requests. Rate limit exceeded. Retry later. Retry after some seconds.
Your session has expired. Session expired. Please log in again. Please sign in to continue.
Loading... Loading, please wait... Loading… Page is loading. Redirecting... If you are not redirected automatically, click here.
If nothing happens, please reload. If the page does not load, enable scripts. If this takes too long, check whether scripts are blocked.
JavaScript is disabled. JavaScript is not enabled. JavaScript is disabled in your browser. JavaScript must be enabled. Cookies are disabled. Cookies must be enabled. noscript
We use cookies to improve your experience. Accept all cookies. By continuing you accept our use of cookies.
抱歉，出错了。抱歉，服务器开小差了。抱歉，没有找到相关内容。很抱歉，您访问的页面不存在。对不起，您访问的页面不存在。对不起，系统出错。非常抱歉，页面出错了。
暂无数据 暂无内容 没有找到符合条件的结果 查询结果为空 没有查询到数据 查无此页 未知错误 操作失败 提交失败 参数错误 非法请求 签名错误
上游服务器没有响应 上游服务器超时 在规定时间内没有响应 无法连接到服务器 无法连接数据库 数据库连接失败 连接数过多 内存不足
网站维护中 网站正在维护 系统维护中 系统升级中 敬请期待 正在建设中 页面建设中 功能开发中
您的浏览器版本过低，请升级浏览器 为了更好的体验，请使用其他浏览器 建议使用最新版浏览器访问
点击这里返回首页 点击此处返回 返回上一页 返回首页 重新加载 刷新页面 刷新重试 联系管理员 查看帮助
请检查是否拦截了脚本 请检查是否屏蔽了脚本 请关闭广告拦截插件后刷新 本网站使用 Cookie 改善体验 接受所有 Cookie
"""
#: Real prose about such strings: it names them as its subject.
_WHO = "模板引擎|报表引擎|渲染引擎|代码生成器|低代码平台|文档系统|数据平台|数据治理工具|数据清洗流程|清洗规则|质检系统|统计软件|排版软件|设计工具|网站监测服务|监控平台|监测系统|运维系统|告警系统|安全网关|防护产品|验证码产品|浏览器插件|测试平台|合同模板|接口文档|手册|规范|说明书|公司的产品|该软件|该功能".split("|")
_DOES = "用|以|将|把|会将|会把|支持|约定用|规定以|允许用户以|可识别|能够识别|会识别|会检查|会检测|自动检测|可检测|统一把|默认将|在发现|若发现|一旦出现|遇到|针对|负责处理|专门处理".split("|")
_WHAT = "双花括号|花括号|大括号|方括号|尖括号|美元符号|百分号|下划线|占位符|变量|参数|字段|空值|缺失值|未定义值|null|NULL|NaN|undefined|N/A|Lorem ipsum|示例文字|填充文字|假文|错误页|错误码|状态码|404|500|502|503|“页面不存在”|“系统繁忙”|“请稍后再试”|JavaScript|脚本|Cookie|空白条款|待填条款|【】|“—”|验证码".split("|")
_THEN = "标记变量|标记字段|表示变量|作为占位符|作为参数写法|作为分隔符|，生成时替换为实际值|，渲染时替换为真实数值|，输出时替换成实际内容|视为缺失值|视为缺测|作缺失处理|按缺失值处理|并剔除|，统计时剔除|予以剔除|自动补全|供预览版式|便于设计师预览|用于预览|时自动告警|时通知运维人员|提示时发出告警|时及时告警|，并转入静态页面|，未启用时返回静态页|，以区分机器访问|，误报率较低|，已服务多家客户|，用户可自行扩展|，客户可自定义|均已填写完毕|已全部填写并确认|均已补齐|表示不适用|表示无数据|的含义见附录|的说明见手册|的写法|的语法|功能".split("|")
_WHO_EN = "The template engine|The report engine|The low-code platform|The document generator|The data platform|The cleaning rules|The statistics package|The layout tool|The design software|The monitoring service|The alerting product|The gateway|The firewall|The captcha product|The manual|The contract|The interface document|Our product".split("|")
_DOES_EN = "marks variables with|uses|replaces|writes parameters in|treats|drops|removes|counts|ships with|previews layouts with|alerts users when a page shows|detects|checks whether visitors enable|recognises|describes|lists|supports|lets clients define".split("|")
_WHAT_EN = "braces|double braces|brackets|placeholders|variables|null values|NaN|undefined values|missing values|N/A|lorem ipsum|sample text|filler text|404 Not Found|error pages|error codes|busy messages|JavaScript|cookies|scripts|blank clauses".split("|")
_VALUES_EN = "Cells|Entries|Values|Measurements|Readings|Fields|Records|Empty cells|Blank values".split("|")
_AS_EN = "stored as|recorded as|marked as|given as|written as|reported as|equal to|left".split("|")
_NOTHING_EN = "NaN|null|undefined|N/A|None|NaN or undefined|null or NaN|blank".split("|")
_THUS_EN = " are dropped.| are excluded.| are removed.| are ignored.| are skipped.| are treated as missing.| are counted as missing.| are left out before averages are taken.| before totals are computed.".split("|")
_THEN_EN = " and replaces them at render time.| that are replaced when a document is made.| as missing readings.| before statistics are computed.| so that designers can preview a layout.| and notifies customers.| and serves a static page otherwise.| for its clients.| in the appendix.| that users may extend.".split("|")


def _joined(*parts: list[str]) -> list[str]:
    """Each part after each part before it, two by two, with a plain third where there is one."""
    out = []
    for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)):
        head = parts[i - 1][0] if i else ""
        tail = parts[i + 2][0] if i + 2 < len(parts) else ""
        out += [head + x + y + tail for x, y in product(a, b)]
    return out


def _spaced(*parts: list[str]) -> list[str]:
    return _joined(*[[x if i == 0 or x[:1] in " .,，。" or not x else " " + x for x in part] for i, part in enumerate(parts)])


def slot_texts() -> list[str]:
    """Unfilled places and lines, each form with each field."""
    out = []
    for fields in (FIELDS_ZH, FIELDS_EN, [f.upper() for f in FIELDS_EN], [f.title() for f in FIELDS_EN]):
        for form in SLOTS + LINES:
            out += [form.format(f) for f in fields]
    return out


def field_texts() -> list[str]:
    """Names of fields as they stand in real text: headings, labels, menus."""
    out = []
    for fields in (FIELDS_ZH, FIELDS_EN, [f.upper() for f in FIELDS_EN], [f.title() for f in FIELDS_EN]):
        for form in ("{0}", "{0}：", "{0}: ", "\n{0}", "## {0}\n", "{0}s | {0}", "、{0}", " {0} ", "-{0}", "（{0}）", "[1]", "，AB-12"):
            out += [form.format(f) for f in fields]
    return out


def notice_texts() -> list[str]:
    lines = [x for x in NOTICES.split("\n") if x] * 4
    lines += _joined(_FIND, _YOURS, _THINGS, _TRY) + _joined(_PLACES, _GONE, _TRY) + _joined(_MACHINES, _STATES, _TRY) + _joined(_ALLOW, _SCRIPTS, _AFTER) + _joined([f"检测到 {x} " for x in _SCRIPTS], _OFF, _ON, _AGAIN) + _joined(_LOGIN, _VIEW) + _joined(_CHECK, _CHECKED)
    return lines + CODES * 8 + _spaced(_PAGES, _MISSING) + _spaced(_NEEDS, _SUBJECTS, _TO)


def filler_texts() -> list[str]:
    lines = [x for x in FILLER.split("\n") if x] * 4
    lines += [f"{LATIN[i]} {LATIN[(i * k + k) % len(LATIN)]} {LATIN[(i + 7 * k) % len(LATIN)]}" for k in range(1, 12) for i in range(len(LATIN))]
    return lines + [f"{a} {b}" for a, b in product(FILLER_WORDS, FILLER_WORDS)] + [f"{a}，{b}" for a, b in product(FILLER_WORDS[:24], FILLER_WORDS[:24])] + [f"{a}{a}{a}" for a in FILLER_WORDS[:24]]


def about_texts() -> list[str]:
    return _joined(_WHO, _DOES, _WHAT, _THEN) + _spaced(_WHO_EN, _DOES_EN, _WHAT_EN, _THEN_EN) + _spaced(_VALUES_EN, _AS_EN, _NOTHING_EN, _THUS_EN)
