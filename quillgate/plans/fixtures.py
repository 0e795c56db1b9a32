"""Small inline tables for the operators the driver's tables hold no rows for. Their VALUES
are read by Spark and by DuckDB alike."""

NOTES = [
    "Aadhaar Number: 1234 5678 9012", "Order id 123456789012 shipped today", "ABCDE1234F", "IFSC: SBIN0001234", "PIN Code: 560001", "Account Number: 12345678901234",
    "Name: Vishal Agrawal", "Address: 12 MG Road, Bengaluru 560001", "call 9876543210 or a@b.co", "DOB: 01/02/1990", "otp 123456", "card number 4111 1111 1111 1111", "nothing to see", "",
    "café 4111111111111111 expiry", "Address: none of it", "full name = Jo Ann\nphone 9876543210", "Bearer abcdefghijklmnop", "token sk-abcdefghijklmnop1234", "me@okbank pays",
    "pan-card-scan.png", "a%40b.co%20x@y.org", "ＡＢＣＤＥ１２３４Ｆ", "QUJDREUxMjM0RiBhbmQgYUBiLmNvIGlzIGhlcmU0MDA=",
]


def sql_text(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """A SELECT over rows; every row is written out so types follow the first."""
    body = ", ".join("(" + ", ".join(map(sql_text, r)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({columns}))"


FIELDS = [
    (1, 0, "password", None, "pw", None, "Your password", None), (1, 1, "text", "cc-number", "n", None, None, None), (1, 2, "file", None, "doc", "upload", "Attach", None),
    (1, 3, "text", None, "fullname", None, None, "Full name"), (1, 4, "text", None, "q", None, "Search", None), (2, 0, "tel", "tel", "phone", None, None, None),
    (2, 1, None, None, None, None, None, None), (2, 2, "text", "street-address", "a1", None, "Line 1", None), (2, 3, "text", None, "company", None, "Company", None), (2, 4, "email", "email", "mail", None, "E-mail", None),
]
FIELD_COLUMNS = "page_id, ord, input_type, autocomplete, name, id, label, placeholder"

FLAGS = [None, True, False]
STATES = [(i, s, n, a, b, c, d) for i, (s, n, a, b, c, d) in enumerate((s, n, a, b, c, d) for s in FLAGS for n in (0, 2) for a in FLAGS for b in (True, False) for c in (True, False) for d in (None, True, False))]
STATE_COLUMNS = "id, scan_safe, regions, redaction_ok, perception_ok, ocr, uncertain"

ACTIONS = [
    (0, "local:fill_credential", "#pw", None, None, 0), (1, "browser:upload_file", None, None, None, 1), (2, "mouse:scroll", None, None, None, 3), (3, "keyboard:tab", None, "Pay now", None, 0),
    (4, "mouse:click", "#submit", None, None, 0), (5, "mouse:click", "#next", "Next", None, 1), (6, "keyboard:type", None, None, "please TRANSFER it", 0), (7, "keyboard:type", None, None, "hello", 3),
    (8, "browser:navigate", None, None, None, 2), (9, None, None, "Design", None, 0), (10, "mouse:click", None, "Delete account", None, 5),
]
ACTION_COLUMNS = "id, variant, path, label, content, attempt"

PAYLOADS = [
    (0, '{"context":"a page with two fields","temperature":0.2}', True), (1, '{"x":320,"y":240,"label":"Submit"}', True), (2, '{"text":"ABCDE1234F"}', False),
    (3, '{"a":[{"b":"write to a@b.co"}]}', False), (4, '{"form":{"password":null}}', False), (5, '{"h":{"authorization":"Bearer abcdefghijklmnop"}}', False),
    (6, '{"fileDataUrl":"x"}', False), (7, '{"d":"data:text/plain;base64,QUJDREUxMjM0RiBhbmQgbW9yZQ=="}', False), (8, '{"t":"mail a%40b.co"}', False), (9, '{"t":"ＡＢＣＤＥ１２３４Ｆ"}', False),
    (10, '{"f":"pan-card-scan.png"}', False), (11, "[[[[[[[[[[[[[[1]]]]]]]]]]]]]]", False), (12, "no json", True), (13, None, True), (14, '{"n":9876543210,"ok":true}', True), (15, '{"p":"call 9876543210"}', False),
]

ORDERED_PAYLOADS = [
    (0, '{"z":"write to a@b.co","a":{"password":1},"m":"or c@d.org"}', "email@$.z, sensitive_key@$.a.password, email@$.m"),
    (1, '{"t":["a@b.co","a@b.co"],"otp":null}', "email@$.t[0], email@$.t[1], sensitive_key@$.otp"),
    (2, "[" + ",".join(['"a@b.co"'] * 12) + "]", ", ".join(f"email@$[{k}]" for k in range(10))),
    (3, "[" * 40 + '"a@b.co"' + "]" * 40, "email@$" + "[0]" * 40), (4, '{"n":{"deep":{"er":"quiet"}}}', ""), (5, None, ""), (6, "plain a@b.co", "email@$"),
]

PERCEPTIONS = [
    (0, '{"elements":[{"type":"button","label":"Next","bbox":{"x":10,"y":5,"width":20,"height":10},"sensitive":false,"confidence":0.9}]}', "button|Next|false|0.9|10|5|20|10", False),
    (1, 'Sure:\n```json\n{"elements":[{"label":"Card"}]}\n```\nDone.', "element|Card|true|0.5|0|0|100|50", False),
    (2, '{"elements":[{"type":"","bbox":{"x":-5,"y":70,"width":"9","height":500},"sensitive":null,"confidence":"high"}]} trailing', "element|-|true|0.5|0|50|0|50", False),
    (3, '{"elements":[]}', "", False), (4, '{"elements":{}}', "unknown_region|-|true|0.0|0|0|100|50", True), (5, "no json here", "unknown_region|-|true|0.0|0|0|100|50", True),
    (6, "", "unknown_region|-|true|0.0|0|0|100|50", True), (7, None, "unknown_region|-|true|0.0|0|0|100|50", True), (8, '{"elements":[{"sensitive":"false","bbox":null}', "unknown_region|-|true|0.0|0|0|100|50", True),
    (9, '{"elements":[{"sensitive":"false","bbox":null},{"sensitive":false}]}', "element|-|true|0.5|0|0|100|50; element|-|false|0.5|0|0|100|50", False),
]

PLANS = [
    (0, '{"actions":[{"variant":"mouse:click"},{"variant":"keyboard:enter"}],"done":false}', 2, None), (1, '```\n{"actions":[]}\n```', 0, None), (2, "", None, "Empty remote response"), (3, None, None, "Empty remote response"),
    (4, '{"done":true}', None, "Remote plan missing actions[]"), (5, "{nothing}", None, "Remote plan is no JSON"), (6, 'I say {"actions":[1]} and stop', 1, None),
]

# label, name, placeholder, input_type, selector_path, visible, disabled
LOCAL_PLANS = [
    (0, "Upload my Aadhaar", [("Aadhaar card", None, None, "file", "#a", True, False), ("", "aadhaar_no", None, "text", "#b", True, None)], "browser:upload_file #a aadhaar_document; local:fill_credential #b aadhaar_number"),
    (1, "log in", [("Password", None, None, "password", "#p", True, False), ("Aadhaar", None, None, "text", "#b", True, False)], "local:fill_credential #p password"),
    (2, "log in", [("Password", None, None, "password", "#p", False, False), ("Password", None, None, "password", "#q", True, True), (None, "", None, "password", "#r", True, False), ("Password", None, None, "password", "#s", None, None)], None),
    (3, None, [(None, None, "secret", "password", None, True, False)], "local:fill_credential password"), (4, "aadhaar", [], None), (5, "aadhaar", None, None),
]

_AT = (1.0, 2.0, 160.0, 100.0)
MEDIA = [
    (1, 0, True, _AT, None, "pan_card.png", "", None, "image/png"), (1, 1, False, _AT, None, "passport.png", None, None, None), (2, 0, True, _AT, None, None, None, "a garden", None),
    (2, 1, True, None, None, "passport.png", None, None, None), (3, 0, True, (0.0, 0.0, 500.0, 100.0), None, None, "a garden", None, "image/png"), (3, 1, None, _AT, None, "passport.png", None, None, None),
]
SEEN = [(1, "face", 0.6, _AT), (1, "signature", 0.5, _AT), (3, "qr_code", 0.9, _AT), (3, "logo", 0.9, _AT), (3, None, 0.9, None)]
REGION_TOTALS = [
    (1, 6, 1, 1, "cc-number,face,file_upload,name,pan,password", False), (2, 5, 1, 0, "email,generic_identity,pan,street-address,tel", True), (3, 1, 0, 1, "qr_code", False),
]

CHECKED_ACTIONS = [
    ('{"variant":"mouse:click","x":1,"y":2}', None), ('{"variant":"mouse:click","x":"1","y":2}', "Action.x must be a number"), ('{"variant":"browser:navigate"}', "Action.url must be a string"),
    ('{"variant":"nope"}', "Unknown action variant: nope"), ("{}", "Unknown action variant: undefined"), ('{"variant":"local:fill_credential","target":{},"credentialRole":"otp"}', "Action.target must include a selectorPath or bbox"),
    ('{"variant":"local:fill_credential","target":{"selectorPath":"#a"},"credentialRole":"otp"}', None), ('{"variant":"keyboard:tab"}', None), ('{"variant":"mouse:drag","from":{},"to":1}', "Action.to must be an object"),
    ('{"variant":"mouse:scroll","x":0,"y":0,"deltaX":0.5}', "Action.deltaY must be a number"), ('{"variant":"keyboard:type","content":3}', "Action.content must be a string"), ('{"variant":"keyboard:type","content":""}', None),
    ('{"variant":"browser:tab:switch","index":null}', "Action.index must be a number"), ('{"variant":"browser:upload_file","target":{"bbox":{"x":1}},"credentialRole":"otp"}', None),
    ('{"variant":"browser:upload_file","target":{"bbox":{"x":1}}}', "Action.credentialRole must be a string"), ('{"variant":"mouse:double_click","x":1e3,"y":-2}', None), ('{"variant":"browser:tab:new"}', None),
    (None, "Action must be an object"), ("7", "Action must be an object"), ("null", "Action must be an object"), ("[]", "Unknown action variant: undefined"),
]
