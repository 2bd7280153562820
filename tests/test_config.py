from claimloom.config import Config


def test_settings_of_file_and_environment(tmp_path, monkeypatch):
    file = tmp_path / ".env"
    file.write_text("# names\nexport CLAIMLOOM_NAMESPACE='http://n/#'\nCLAIMLOOM_CACHE_EXPIRY_S=60 # a minute\nCLAIMLOOM_IGNORE_URLS=a,b\nCLAIMLOOM_SITE_URL=http://file/\n")
    monkeypatch.setenv("CLAIMLOOM_SITE_URL", "http://environment/")
    config = Config.from_env(str(file), min_similarity=0.5)
    assert (config.namespace, config.cache_expiry_s, config.ignore_urls, config.site_url, config.min_similarity) == ("http://n/#", 60, ("a", "b"), "http://environment/", 0.5)
    assert Config.from_env(str(tmp_path / "none")).namespace == Config().namespace
