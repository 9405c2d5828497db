import pytest

from tessera.llm.credential_text import literals

BODY = "MIIEpAIBAAKCAQEA7bq0"


@pytest.mark.parametrize("value", ["token-relation-basket-outline87", "secret_9fK2mQ7xLw81", "password-kettle-anchor-parser45", "my-harbor-invoice-meter12", "default.qX72hhZp1", "token-" + "x" * 60 + "q7", "password1", "my-" + "1" * 60 + "z"])
def test_a_value_may_begin_like_a_placeholder(value):
    assert [(no, v) for no, _, v in literals(f'var pwd = "{value}";')][:1] == [(1, value)]


@pytest.mark.parametrize("value", ["your-api-key-here", "changeme123", "my_secret_token", "secret", "set-me", "your_xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "my-token-123", "<token>", "example_password_123", "TODO", "replace-with-your-token"])
def test_whole_placeholders_are_none(value):
    assert list(literals(f'var pwd = "{value}";')) == []


@pytest.mark.parametrize(
    "middle",
    [
        f"{BODY * 3}\n",
        f"Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,1F2E3D4C\n\n{BODY * 3}\n",
        f"Version: GnuPG v2\n\n{BODY * 3}\n",
        f"\n{BODY * 3}\n",
        f"{BODY}{BODY[:12]}\n{BODY}{BODY[:12]}\n",
        f"# Comment: x\n#\n# {BODY * 3}\n",
    ],
)
def test_a_key_body_counts_past_headers_and_blank_lines(middle):
    text = f"a\n-----BEGIN RSA PRIVATE KEY-----\n{middle}-----END RSA PRIVATE KEY-----\n"
    assert [(no, form) for no, form, _ in literals(text)][:1] == [(2, "private key")]
    assert len([1 for _, form, _ in literals(text) if form == "private key"]) == 1


@pytest.mark.parametrize("middle", ["...\n", "", "<your key>\n", f"-----END RSA PRIVATE KEY-----\n{BODY * 3}\n"])
def test_a_key_without_body_is_none(middle):
    assert list(literals(f"-----BEGIN RSA PRIVATE KEY-----\n{middle}-----END RSA PRIVATE KEY-----\n")) == []
